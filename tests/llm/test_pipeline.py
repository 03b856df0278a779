"""Each stage of the pipeline on its own input."""

import re

import corpus_pipeline as P
from sawmill.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in queries.toxic(docs, labels).where("predicted = 1").collect()}
    one = P.toxicity(spark, docs, SF)
    assert one.columns == COLUMNS
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()} - toxic

    two = P.exact_dedup(spark, one, SF)
    first = {}
    for r in sorted(one.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert two.columns == COLUMNS and {r["doc_id"] for r in two.collect()} == set(first.values())

    three = P.near_dedup(spark, two, SF).cache()
    sets = {}
    for r in two.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in three.collect()} == {i for i in sets if find(i) == i}

    four = P.mix_sources(spark, three, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    counts = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == COLUMNS and set(counts) <= set(texts) and max(counts.values()) <= 3
    size = {i: len((t or "").encode().split()) for i, t in texts.items()}
    assert abs(sum(size[i] * n for i, n in counts.items()) - sum(size.values())) <= 20 * max(size.values())

    five = P.encode(spark, four, SF)
    assert five.count() == four.count()


def test_rows_of_one_id_and_null_ids(spark):
    rows = [(7, "a b c", "x", 1), (7, "a  b c", "x", 2), (2, "a b c", "y", 3), (7, "other words", "y", 4), (None, "other words", "x", 5),
            (None, "alone here", "x", 6), (None, "alone here", "x", 6), (3, None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in P.exact_dedup(spark, docs, SF).collect())
    assert kept == [(-1, "alone here"), (2, "a b c"), (3, ""), (7, "other words")]
    near = P.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns
    kept = sorted((r["doc_id"] or -1, r["text"] or "") for r in near.collect())
    assert kept == [(-1, "alone here"), (2, "a b c"), (3, ""), (7, "other words")]
    mixed = P.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    by_source = {r["source"]: r["n"] for r in mixed.selectExpr("source", "size(split(text, ' +')) AS w").groupBy("source").sum("w").withColumnRenamed("sum(w)", "n").collect()}
    total = 3 + 3 + 3 + 2 + 2 + 2 + 2
    assert abs(by_source["x"] - total / 3) <= 2 and abs(by_source["y"] - 2 * total / 3) <= 2
    assert P.toxicity(spark, docs, SF).count() == len(rows)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_what_a_stage_was_told_is_planned_once(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and {i % 5}", "x") for i in range(40)], "doc_id long, text string, source string")
    for stage in (P.exact_dedup, P.near_dedup, P.mix_sources):
        plan = stage(spark, docs, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 2 and plan.count("Aggregate") <= 1 and "MapInArrow" not in plan
