import pytest

from sawmill.functions.cursor import encode_cursor_value
from sawmill.plans.args import ArgumentError, parse_aggregate, parse_search


def test_absent_values_are_ignored():
    req = parse_search({"service": " ", "level": "null", "q": "Undefined", "limit": "", "cursor": "",
                        "attr.tier": "null"})
    assert (req.service, req.level, req.q, req.limit, req.cursor, req.attributes) == (None, None, None, 100, None, {})


def test_search_errors_reported_together():
    with pytest.raises(ArgumentError) as err:
        parse_search({"since": "2024-01-02T00:00:00Z", "until": "2024-01-02T00:00:00Z", "limit": "1001",
                      "level": "verbose", "cursor": "@@@@"})
    assert err.value.errors == [
        "level must be one of: debug, info, warn, error", "until must be greater than since",
        "limit must be an integer between 1 and 1000", "cursor must be a valid base64url-encoded log cursor"]


def test_search_accepts_cursor_and_attrs():
    token = encode_cursor_value("2024-01-17T06:45:12.250Z", 98_431)
    req = parse_search({"cursor": token, "attr.tier": "gold, large", "limit": "5"})
    assert req.cursor == token and req.attributes == {"tier": "gold, large"} and req.limit == 5


def test_aggregate_contract():
    with pytest.raises(ArgumentError) as err:
        parse_aggregate({"service": " "})
    assert err.value.errors == ["since must be a valid ISO 8601 date", "until must be a valid ISO 8601 date",
                                "bucket is required", "service must be a non-empty string"]
    with pytest.raises(ArgumentError) as err:
        parse_aggregate({"since": "2024-01-01", "until": "2024-01-02", "bucket": "2h", "group_by": "host"})
    assert err.value.errors == ["bucket must be one of: 1m, 5m, 1h, 1d", "group_by must be one of: service, level"]
    req = parse_aggregate({"since": "2024-01-01", "until": "2024-01-02", "bucket": "1h", "service": "null"})
    assert req.service is None and req.bucket == "1h"


@pytest.mark.parametrize("limit", ["0", "1001", "1.0", "-1", "x", "\u0663", True, 2.0])
def test_limit_out_of_contract(limit):
    with pytest.raises(ArgumentError) as err:
        parse_search({"limit": limit, "service": 3, "attr.": "x"})
    assert err.value.errors == ["service must be a string", "limit must be an integer between 1 and 1000",
                                "attribute filter attr. must be a string"]


def test_limits_and_time_bounds_in_contract():
    assert parse_search({"limit": 1000}).limit == 1000 and parse_search({"limit": " 7 "}).limit == 7
    with pytest.raises(ArgumentError) as err:
        parse_search({"since": "null", "until": 5, "q": 5})
    assert err.value.errors == ["since must be a valid ISO 8601 date", "until must be a valid ISO 8601 date", "q must be a string"]
