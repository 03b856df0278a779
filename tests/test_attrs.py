from sawmill.functions.attrs import attrs_kv, attrs_text, kv_token
from sawmill.functions.patterns import like_pattern
from sawmill.operators.filters import filter_attrs, filter_message


def test_kv_encoding_golden():
    assert kv_token("tier", "gold") == "4:tier=gold"
    assert kv_token("requestId", "req-123") == "9:requestId=req-123"


def test_attrs_text_canonical_numbers(spark):
    doc = ('{"i":1,"f":1.0,"e":1e2,"s":"x","b":true,"n":null,"small":1e-7,'
           '"big":9007199254740993,"neg":-0,"half":2.50}')
    m = spark.createDataFrame([(doc,)], "a string").select(attrs_text("a").alias("m")).first()["m"]
    assert m == {"i": "1", "f": "1", "e": "100", "s": "x", "b": "true", "n": None,
                 "small": "0.0000001", "big": "9007199254740992", "neg": "0", "half": "2.5"}


def test_attrs_kv_sorted_null_and_empty(spark):
    df = spark.createDataFrame([('{"b":"2","a":1,"z":null}',), ("{}",)], "a string")
    rows = df.select(attrs_kv(attrs_text("a")).alias("kv")).collect()
    assert rows[0]["kv"] == ["1:a=1", "1:b=2", None]
    assert rows[1]["kv"] is None


def test_attribute_filter_semantics(spark):
    df = spark.createDataFrame(
        [(1, '{"tier":"gold","n":5}'), (2, '{"tier":null}'), (3, "{}"), (4, '{"😀":"x"}')],
        "id long, attributes string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filter_attrs(df, {"tier": "gold", "n": "5"})) == [1]
    assert ids(filter_attrs(df, {"tier": "null"})) == []
    assert ids(filter_attrs(df, {"😀": "x"})) == []  # UTF-16 key length differs: never matches


def test_like_pattern_normalization(spark):
    assert like_pattern("50%_OFF") == "%50%_OFF%"
    assert like_pattern(r"a\b") == "%ab%"
    assert like_pattern(r"a\%") == r"%a\%%"
    assert like_pattern("end\\") == r"%end\%"
    df = spark.createDataFrame([("Total 50% OFF",), ("total 50x OFF",), ("ends with 100%",), ("no",)], "message string")
    got = lambda q: sorted(r["message"] for r in filter_message(df, q).collect())
    assert got("50%_off") == ["Total 50% OFF", "total 50x OFF"]
    assert got(r"50\%") == ["Total 50% OFF"]
    assert got("100\\") == ["ends with 100%"]
    assert got(r"t\otal") == ["Total 50% OFF", "total 50x OFF"]


def test_attribute_filter_odd_keys(spark):
    import json
    pairs = (("a.b", "1"), ("it's", "2"), ('q"x', "3"), ("both'\"", "4"), ("a\\b", "5"), ("[x]", "6"))
    df = spark.createDataFrame([(1, json.dumps(dict(pairs)))], "id long, attributes string")
    for key, value in pairs:
        assert filter_attrs(df, {key: value}).count() == 1, key
        assert filter_attrs(df, {key: value + "x"}).count() == 0, key


def test_sql_function_equals_column_form(spark, small_logs):
    from sawmill.functions.sql import register_sql_functions
    register_sql_functions(spark)
    doc = '{"i":1,"f":1.5,"e":1e2,"s":"x","b":false,"n":null,"small":1e-7,"o":{"x":1}}'
    probe = spark.createDataFrame([(0, doc), (1, "{}"), (2, "not json")], "id long, attributes string")
    for df in (small_logs.select("id", "attributes"), probe):
        df.createOrReplaceTempView("kv_probe")
        via_sql = spark.sql("SELECT id, logs_attributes_kv(attributes) AS kv FROM kv_probe")
        via_col = df.select("id", attrs_kv(attrs_text("attributes")).alias("kv"))
        assert sorted(via_sql.collect()) == sorted(via_col.collect())
