"""

Parameters arrive as text (query-string style).  A contract is a table of rules, one per field; one
function walks it and reports all problems together, in the table's order, in one ``ArgumentError``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from sawmill.functions.cursor import decode_cursor_value
from sawmill.functions.times import to_utc_naive
from sawmill.schema import (
    ABSENT_WORDS, ATTR_PREFIX, BUCKET_WIDTHS, DEFAULT_LIMIT, DEFAULT_RETENTION_BATCH, DEFAULT_RETENTION_DAYS,
    GROUP_BY_VALUES, LEVELS, MAX_LIMIT, MESSAGES, MIN_LIMIT, SETTING_BATCH, SETTING_DAYS,
)


class ArgumentError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass
class SearchRequest:
    service: str | None = None
    level: str | None = None
    since: str | None = None
    until: str | None = None
    q: str | None = None
    limit: int = DEFAULT_LIMIT
    cursor: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class AggregateRequest:
    since: str
    until: str
    bucket: str
    group_by: str | None = None
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)


def text(raw):
    return raw if isinstance(raw, str) else None


def nonblank(raw):
    return raw if isinstance(raw, str) and raw.strip() else None


def one_of(values) -> Callable:
    return lambda raw: raw if isinstance(raw, str) and raw in values else None


def whole(least: int, most: int | None = None) -> Callable:
    """An integer or its plain digits, within the bounds."""
    def parse(raw):
        digits = str(raw).strip()
        plain = isinstance(raw, (int, str)) and not isinstance(raw, bool) and digits.isascii() and digits.isdigit()
        return int(digits) if plain and least <= int(digits) <= (int(digits) if most is None else most) else None
    return parse


def time(raw):
    try:
        to_utc_naive(raw)
    except (TypeError, ValueError, AttributeError):
        return None
    return raw if isinstance(raw, str) else None


def cursor(raw):
    return raw if isinstance(raw, str) and decode_cursor_value(raw) is not None else None


@dataclass(frozen=True)
class Rule:
    """How a field is read: ``parse`` gives None for a wrong value; words in ``absent`` (any case) mean "not given"."""
    name: str
    parse: Callable
    message: str
    absent: frozenset[str] = frozenset(ABSENT_WORDS)
    missing: str | None = None  # the error where the field isn't there

    def read(self, params: dict) -> tuple[object, str | None]:
        if self.name not in params:
            return None, self.missing
        raw = params[self.name]
        if isinstance(raw, str) and raw.strip().lower() in self.absent:
            return None, None
        value = self.parse(raw)
        return value, self.message if value is None else None


STRICT: frozenset[str] = frozenset()
LEVEL = Rule("level", one_of(LEVELS), MESSAGES["level"])
Q = Rule("q", text, MESSAGES["q"])
SEARCH = (
    Rule("service", text, MESSAGES["service"]),
    LEVEL,
    Rule("since", time, MESSAGES["since"], STRICT),
    Rule("until", time, MESSAGES["until"], STRICT),
    Q,
    Rule("limit", whole(MIN_LIMIT, MAX_LIMIT), MESSAGES["limit"]),
    Rule("cursor", cursor, MESSAGES["cursor"]),
)
AGGREGATE = (
    Rule("since", time, MESSAGES["since"], STRICT, MESSAGES["since"]),
    Rule("until", time, MESSAGES["until"], STRICT, MESSAGES["until"]),
    Rule("bucket", one_of(BUCKET_WIDTHS), MESSAGES["bucket"], STRICT, MESSAGES["no_bucket"]),
    Rule("group_by", one_of(GROUP_BY_VALUES), MESSAGES["group_by"]),
    Rule("service", nonblank, MESSAGES["service_blank"], frozenset(ABSENT_WORDS) - {""}),
    LEVEL,
    Q,
)


def _walk(rules: tuple[Rule, ...], params: dict) -> dict:
    """The given fields by name, with ``attributes``; or an ``ArgumentError`` with every problem."""
    values, problems = {}, {}
    for rule in rules:
        value, problem = rule.read(params)
        if problem:
            problems[rule.name] = problem
        elif value is not None:
            values[rule.name] = value
    if {"since", "until"} <= values.keys() and to_utc_naive(values["until"]) <= to_utc_naive(values["since"]):
        problems["until"] = MESSAGES["range"]
    given = {k: v for k, v in params.items() if k.startswith(ATTR_PREFIX)}
    errors = [problems[r.name] for r in rules if r.name in problems]
    errors += [MESSAGES["attribute"].format(key=k) for k in given if k == ATTR_PREFIX]
    if errors:
        raise ArgumentError(errors)
    values["attributes"] = {k.removeprefix(ATTR_PREFIX): v for k, v in given.items()
                            if isinstance(v, str) and v.strip().lower() not in ABSENT_WORDS}
    return values


def parse_search(params: dict) -> SearchRequest:
    """Search parameters → ``SearchRequest`` or ``ArgumentError``."""
    return SearchRequest(**_walk(SEARCH, params))


def parse_aggregate(params: dict) -> AggregateRequest:
    """Aggregate parameters → ``AggregateRequest`` or ``ArgumentError``."""
    return AggregateRequest(**_walk(AGGREGATE, params))


def retention_settings(env: dict) -> tuple[int, int]:
    """(days, batch size) from text settings; 30 and 5000 where unset or empty."""
    defaults = {SETTING_DAYS: DEFAULT_RETENTION_DAYS, SETTING_BATCH: DEFAULT_RETENTION_BATCH}
    given = {k: str(env[k]) for k in defaults if env.get(k) not in (None, "")}
    wrong = [MESSAGES["setting" if whole(0)(v) is None or v != v.strip() else "setting_low"].format(name=k)
             for k, v in given.items() if v != v.strip() or whole(1)(v) is None]
    if wrong:
        raise ArgumentError(wrong)
    return tuple(int(given.get(k, d)) for k, d in defaults.items())
