"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sawmill.llm import bpe, chat, embeddings, exact_dedup, interpolation, jaccard, licenses, mixing, pages, queries, toxicity
from sawmill.llm import components as components_module
from sawmill.llm.common import fold, written
from sawmill.llm.components import components
from sawmill.llm.words import shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, size string, frame string"
rnd = random.Random(5)
VOCAB = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]


def words(n):
    return [rnd.choice(VOCAB) for _ in range(n)]


def rows():
    base = [words(rnd.randint(1, 120)) for _ in range(40)]
    out = [None, "", " \n\t", "one", "One", "a b c d", "a  b\nc d", "x" * 5000, " ".join(words(6000))]
    for w in base:
        out.append(" ".join(w))
        for _ in range(rnd.randint(0, 3)):
            v = list(w)
            v[rnd.randrange(len(v))] = "changed"
            out.append(rnd.choice(["  ", "\n"]).join(v))
    out += [" ".join(base[0])] * 12  # a large group of copies
    docs = [(i, t, "en", rnd.choice(["a", "b", None, "c"]), 0, "k", "i", "s", "f") for i, t in enumerate(out)]
    return docs + [docs[12], docs[12], (None, "null id", "en", "a", 0, "", "", "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_word_hashes_match_split():
    texts = [b"", b" ", b"Aa b\x0bc", b"a\x00 a", b"x" * 3_000_000 + b" y", b"aa B c"]
    for t, h in zip(texts, word_hashes(texts), strict=True):
        assert len(h) == len(t.lower().split())
    got = list(word_hashes(texts))
    assert got[2][0] == got[5][0] and got[3][0] != got[3][1] and got[2][1] == got[5][1]


def test_words_that_cancel_out_in_sums_are_told_apart(spark):
    def thue_morse(n):
        x = b"a"
        while len(x) < n:
            x += x.translate(bytes.maketrans(b"ab", b"ba"))
        return x
    for n in (8, 16, 64, 128, 512, 1024, 2048):
        one = thue_morse(n)
        two = one.translate(bytes.maketrans(b"ab", b"ba"))
        a, b, both = word_hashes([one, two, one + b" " + two])
        assert a[0] != b[0] and both.tolist() == [a[0], b[0]]
    x, y = thue_morse(512).decode(), thue_morse(512).decode().translate(str.maketrans("ab", "ba"))
    got = jaccard.jaccard_join(spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_connects_what_its_pairs_connect():
    forest, rng = components_module.forest, np.random.default_rng(5)
    for n, m in ((2, 1), (30, 20), (300, 280), (50, 400)):
        ids = rng.integers(-(1 << 62), 1 << 62, n)
        pairs = ids[rng.integers(0, n, (m, 2))]
        root = {int(i): int(i) for i in ids}
        for _ in range(n):
            for a, b in pairs.tolist():
                root[a] = root[b] = min(root[a], root[b])
        assert sorted(map(tuple, forest(pairs).tolist())) == sorted((i, root[i]) for i in set(pairs.ravel().tolist()) if root[i] != i)
    line = np.stack([np.arange(5000), np.arange(1, 5001)], 1)
    assert (forest(line)[:, 1] == 0).all() and len(forest(line)) == 5000


def _rounds(monkeypatch):
    """Counts by name what components write: their edges, and those of each round."""
    names, real = Counter(), components_module.written

    def seen(df, name):
        names[name] += 1
        return real(df, name)

    monkeypatch.setattr(components_module, "written", seen)
    return names


def test_components_of_stars_take_no_round(spark, monkeypatch):
    names = _rounds(monkeypatch)
    edges = [(0, i) for i in range(1, 40)] + [(i, 100) for i in range(101, 120)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "stars").collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 120)}} and names["stars"] == 1


def test_components_of_edges_in_few_tasks_take_no_round(spark, monkeypatch):
    names = _rounds(monkeypatch)
    edges = [(i, i + 1) for i in range(400) if i % 50] + [(900, 401), (5, 5)]  # lines, that took a round for each halving
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4), "lines").collect()]
    assert sorted(got) == sorted([(i, 1 + (i - 1) // 50 * 50) for i in range(1, 401)] + [(401, 401), (900, 401)]) and names["lines"] == 1


def test_components_of_edges_in_many_tasks(spark, monkeypatch):
    """Tasks that hold a part of the edges leave rounds; ids are named once, also where tasks name an edge twice."""
    names, plans, real = _rounds(monkeypatch), [], components_module._open

    def told(edges):
        plans.append(edges)
        return real(edges)

    monkeypatch.setattr(components_module, "_open", told)
    rng = np.random.default_rng(8)
    edges = [(int(a) % 300 - 20, int(b) % 300 - 20) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2001 + i) for i in range(80)] + edges[:50]
    root = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "parts").collect()]
    finally:
        spark.conf.set(key, "true")
    assert sorted(got) == sorted(root.items()) and names["parts"] == len(plans) > 1


def test_stars_of_a_task_are_joined_few_at_a_time(monkeypatch):
    monkeypatch.setattr(components_module, "HELD", 16)
    rng = np.random.default_rng(9)
    for n in (0, 1, 15, 16, 17, 200):
        pairs = np.sort(rng.integers(0, 90, (n, 2)), axis=1)[:, ::-1]
        batches = [pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["hi", "lo"]) for x in np.array_split(pairs, 3)]
        out = list(components_module._stars(iter(batches)))
        got = np.array([[a, b] for x in out for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]).reshape(-1, 2)
        forest = lambda x: sorted(map(tuple, components_module.forest(x).tolist()))
        assert len(got) <= n and all(x.num_rows <= 32 for x in out) and (not n or forest(got) == forest(pairs))


def test_chains_of_near_copies_take_few_rounds(spark, monkeypatch):
    names = _rounds(monkeypatch)
    base = words(200)
    some = [(i, " ".join(base[:2 * k] + words(1) + base[2 * k + 1:])) for i, k in enumerate(range(90))]
    got = jaccard.jaccard_join(spark.createDataFrame(some, "doc_id long, text string").repartition(4)).drop("set_key")
    assert Counter(tuple(r) for r in got.collect()) == brute_jaccard(some)
    assert names["chains"] <= 2  # the chains, and a round where parts differ


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t in collected(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = Counter()
    for t, ids in groups.items():
        least = min((x for x in ids if x is not None), default=None)
        for i in ids:
            want[(i, least, len(ids), i == least, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, digest=True).collect()) == want
    plain = exact_dedup.exact_dedup(docs).collect()
    assert Counter(tuple(r)[:4] for r in plain) == Counter(k[:4] for k in want.elements())
    # with one bit everything is a false positive: results stay
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, digest=True, prefix=1, bits=1).collect()) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def brute_jaccard(pairs):
    sets = []
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


def test_jaccard_join(docs, empty, monkeypatch):
    want = brute_jaccard(collected(docs))
    got = jaccard.jaccard_join(docs).drop("set_key")
    assert Counter(tuple(r) for r in got.collect()) == want
    assert jaccard.jaccard_join(empty).count() == 0


def test_jaccard_families_left_open_by_their_pivot(spark, monkeypatch):
    # a chain of texts that each share most with the next, and passages shared by many that aren't near copies
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    start = words(200)
    chain, now = [], list(start)
    for k in range(12):
        chain.append(" ".join(now))
        now = now[8:] + words(8)
    passage = words(60)
    shared = [" ".join(passage + words(25)) for _ in range(15)]
    some = list(enumerate(chain + shared))
    got = jaccard.jaccard_join(spark.createDataFrame(some, "doc_id long, text string").repartition(4)).drop("set_key")
    assert Counter(tuple(r) for r in got.collect()) == brute_jaccard(some)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 12))
    near = [(b + rng.normal(size=12) * 0.08).tolist() for b in base for _ in range(3)]
    vecs = [*base.tolist(), *near, base[0].tolist(), (2 * base[1]).tolist(), None, [], [0.0] * 12, [None] + [1.0] * 11,
            [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, 2.0], [1.0, 2.0]]
    some = [(i, v, "x", "y") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>, node string, kept string").repartition(3)

    def brute():
        ok = {i: np.array(v) for i, v, *_ in some if v and None not in v and np.isfinite(v).all() and any(v)}
        links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.9} for i in ok}
        comp = {}
        for i in range(len(some)):
            if i not in comp:
                todo = [i]
                while todo:
                    x = todo.pop()
                    if x not in comp:
                        comp[x] = i
                        todo += links.get(x, ())
        return {i: (len(links.get(i, ())), comp[i], comp[i] == i) for i in range(len(some))}
    want = brute()
    for block in (2048, 2):
        assert {r[0]: tuple(r)[1:] for r in embeddings.near_vectors(df, block=block).collect()} == want
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_interpolation(docs, empty, monkeypatch):
    seen = {}
    learn = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda c: seen.setdefault("w", learn(c)))
    rest = fold(F.col("doc_id"), 7)
    role = F.when(rest == 2, "test").when(rest == 5, "dev").otherwise("main")
    got = interpolation.interpolated_scores(docs, role, frame_chars=4000).collect()
    pairs = [(i, (t or "").encode().lower().split() + [None]) for i, t in collected(docs)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in pairs if not held(i) for w in t)
    c2 = Counter(p for i, t in pairs if not held(i) for p in zip([None, *t], t))
    n, v, w = sum(c.values()), len(c), seen["w"]
    want = []
    for i, t in pairs:
        p = 0.0
        for h, x in zip([None, *t], t):
            b = int(math.log2(c[h])) + 1 if c[h] else 0
            p += math.log10(w[b, 0] / (v + 1) + w[b, 1] * c[x] / n + w[b, 2] * c2[h, x] / max(c[h], 1))
        want.append((i, held(i), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), p))
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == e[:5] and g[5:] == pytest.approx(e[5:])
    assert np.allclose(w.sum(1), 1) and (w[1:] > 0).all()
    assert interpolation.interpolated_scores(empty, role).count() == 0
    assert all(math.isfinite(r["score"]) for r in interpolation.interpolated_scores(docs, F.lit("test")).collect())


def test_bpe_against_the_library(docs, empty):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges, cut, split = bpe.Merges(ranks), bpe.regex.compile(bpe.SEGMENT), bpe.regex.compile(public_tokenizers.PATTERN)
    odd = "ab eé'sST 1٢.,!?\n\r\t\x0b\x1c\x1f\x85\xa0 ​﻿中😀<>0"
    for _ in range(2000):
        s = "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 40)))
        w = [x.encode() for seg in cut.findall(s) for x in split.findall(seg)]
        assert merges.encode(w)[0].tolist() == library.encode_ordinary(s)
    for s in ("a" * 3000, "abc" * 500, "😀" * 300, "x" * 65, "ththere" * 90):
        assert merges.encode([s.encode()])[0].tolist() == library.encode_ordinary(s)
    out = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN, frame_chars=5000), ranks).collect()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in collected(docs))
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    assert bpe.bpe_encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_deals_frames_and_asks_in_one_shuffle(spark, tmp_path, monkeypatch):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = [(i % 50, f"some Words {i * i} and {i} more of them") for i in range(300)] + [(None, "no id"), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    stored, took = spark.read.parquet(f"{tmp_path}/docs"), []
    monkeypatch.setattr(bpe, "written", lambda df, name: took.append(name) or written(df, name))
    encode = lambda df: bpe.bpe_encode(df, ranks, public_tokenizers.PATTERN, frame_chars=500)
    out = encode(stored)
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in out.collect())
    assert sum(got.values()) == len(rows) and not took  # no frame is kept beside the shuffle
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()  # and all of them are made once
    # rows that were shuffled may come in another order if a task is run again: they are written first
    assert got == Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in encode(stored.repartition(5)).collect())
    assert took == ["bpe-texts"]


def test_bpe_frames_of_equal_content(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = Counter()
    for r in bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN).collect():
        want[(r["doc_id"], bytes(r["ids"]))] += 2
    got = bpe.bpe_encode(docs.union(docs), ranks, public_tokenizers.PATTERN, frame_chars=5000).collect()  # equal partitions
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    # a text that fills a frame, in a row: once per copy of the mix
    long = spark.createDataFrame([(1, "some words " * 100)] * 3 + [(2, "x")], "doc_id long, text string").coalesce(1)
    got = Counter(r["doc_id"] for r in bpe.bpe_encode(long, ranks, public_tokenizers.PATTERN, frame_chars=1000).collect())
    assert got == {1: 3, 2: 1}


def test_toxicity(spark, docs, empty):
    bad = ["vile", "nasty", "scummy"]
    texts = [" ".join(words(40)) for _ in range(300)]
    ys = [int(i % 6 == 0) for i in range(300)]
    texts = [t.replace(" ", f" {bad[i // 6 % 3]} ", 3) if y else t for i, (t, y) in enumerate(zip(texts, ys, strict=True))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "vile " * 20000), (None, "some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(ys)] + [(None, 1), (1001, None), (77, 5)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels, fold(F.col("_id"), 4) != 2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(by[i]["predicted"] == ys[i] for i in held)
    for i in held:
        assert {texts[i][s["start"]:s["end"]] for s in by[i]["spans"]} <= set(bad)
    assert by[1000]["predicted"] == by[1001]["predicted"] == 0 and by[1002]["predicted"] == 1
    assert toxicity.toxicity(empty, labels, F.lit(True)).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(df, labels.where("false"), F.lit(True)).collect()} == {0}


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    e, trans, start = rng.normal(size=(3, 5)), np.exp(rng.normal(size=(2, 2))), np.array([0.5, 0.5])
    got, xi = toxicity.forward_backward(e, trans, start, pairs=True)
    for r in range(3):
        total, on, pair = 0.0, np.zeros(5), np.zeros((4, 2, 2))
        for m in range(32):
            y = [m >> t & 1 for t in range(5)]
            p = start[y[0]] * np.exp(sum(e[r, t] * y[t] for t in range(5))) * np.prod([trans[y[t], y[t + 1]] for t in range(4)])
            total += p
            on += p * np.array(y)
            for t in range(4):
                pair[t, y[t], y[t + 1]] += p
        assert np.allclose(got[r], on / total)
        assert np.allclose(xi[:, :, :, r].transpose(2, 0, 1), pair / total)


def test_marginals_cross_chains():
    forest, rng = components_module.forest, np.random.default_rng(5)
    trans = np.exp(rng.normal(size=(2, 2)))
    field = toxicity.Field(None, None, None, trans, 0.0, None)
    table = rng.normal(size=(50, 3)) * 2
    docs = [list(rng.integers(0, 50, n)) for n in (10_000, 0, 1, 127, 128, 129, 700)]
    for doc, got in zip(docs, toxicity.marginals(field, docs, table), strict=True):
        if doc:
            e = table[doc, 0].copy()
            e[1:] += table[doc[:-1], 1]
            e[:-1] += table[doc[1:], 2]
            assert np.allclose(got, toxicity.forward_backward(e[None], trans, np.array([0.5, 0.5]))[0][0])


def test_toxicity_fits_its_field_in_a_task(spark, monkeypatch):
    texts = [f"some plain words about topic {i} here" + (" vilewordish" if i % 3 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    here = toxicity.fit(toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", F.lit(True)))
    monkeypatch.setattr(toxicity, "Vocabulary", None)  # here only: the tasks have modules of their own
    field = toxicity._fitted(toxicity.sample_rows(docs, labels, "doc_id", "text", "toxic", F.lit(True)))
    assert np.array_equal(field.own, here.own) and np.array_equal(field.calibration, here.calibration)
    got = toxicity.toxicity(docs, labels, F.lit(True)).collect()
    assert {r["doc_id"] for r in got if r["predicted"]} == set(range(0, 300, 3))


def test_toxicity_learns_from_long_texts_and_repeated_rows(spark):
    rows = [(i, "plain words here " * (2_000 if i == 1 else 5) + ("vile thing" if i % 4 == 0 else "")) for i in range(200)] + [(3, "again")] * 3
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _hash string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    pick = lambda **k: toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", F.lit(True), **k)
    assert Counter(pick()) == Counter((t, int(i % 4 == 0)) for i, t in rows[:201])
    assert len(pick(sample=50)) == 50 and pick(sample=50) == pick(sample=50)
    assert sum(len(t) for t, _ in pick(total_chars=1_000)) <= 1_000 and len(pick(total_chars=20_000)) >= 199


# Expected by hand, from the licences' own texts and headers.
LICENSE_CASES = [
    ("Words.\nReleased under the MIT License.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice "
     "and this permission notice shall be included in all copies. Some words. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY.", ["MIT"]),
    (None, []), ("", []), ("no licence at all. None.", []),
    ("GNU General Public License, version 3, or (at your option) any later version.", ["GPL-3.0-or-later"]),
    ("GNU General Public License, version 3. More words.", ["GPL-3.0-only"]),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
     "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nYou should have received a copy of the "
     "GNU General Public License along with this program.", ["GPL-3.0-or-later"]),
    (" * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n"
     " * of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, "
     "or (at your option) any later version.", ["LGPL-2.1-or-later"]),
    ("Licensed under either the MIT license or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("Not licensed under the Apache License, Version 2.0.", []),
    ("It is no longer licensed under the GNU General Public License, version 2, or any later version.", []),
    ("Not released under the Apache License, Version 2.0 but released under the MIT License.", ["MIT"]),
    ("Unlike the MIT License, the Apache License, Version 2.0 speaks of patents.", []),
    ("Version 3 of the program is out, or later.", []),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]), ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("// SPDX-License-Identifier: LGPL-3.0-only", ["LGPL-3.0-only"]), ("released under AGPLv3", ["AGPL-3.0-only"]),
    ("This file is distributed under the GPL.", ["GPL-1.0-or-later"]),
    ("Licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
    ("licensed under Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", ["CC-BY-NC-ND-4.0"]),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://x", ["Apache-2.0"]),
    ("Redistribution and use in source and binary forms are permitted:\n1. Redistributions of source code must retain the above copyright notice.\n"
     "2. Redistributions in binary form must reproduce the above copyright notice.\n3. Neither the name of Them may be used to endorse or promote products.",
     ["BSD-3-Clause"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("available under the 3-clause BSD license", ["BSD-3-Clause"]), ("covered by the Eclipse Public License 2.0", ["EPL-2.0"]),
    ("Cc and MIT are words. " * 20_000 + "Released under MIT", ["MIT"]),
]


def test_licenses(spark, empty):
    rows = [(i, text, "x") for i, (text, _) in enumerate(LICENSE_CASES)]
    got = licenses.scan_licenses(spark.createDataFrame([*rows, rows[2], (None, "MIT", "x")], "doc_id long, text string, licenses string")).collect()
    by_id = {r["doc_id"]: r["licenses"] for r in got}
    assert [by_id[i] for i in range(len(rows))] == [licences for _, licences in LICENSE_CASES]
    assert len(got) == len(rows) + 2 and by_id[None] == []
    assert licenses.scan_licenses(empty).count() == 0


def test_license_oracle_agrees_with_the_cases(tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, text) for i, (text, _) in enumerate(LICENSE_CASES)])
    got = dict(con.execute(f"SELECT doc_id, licenses FROM ({licenses.oracle()})").fetchall())
    assert [got[i] for i in range(len(LICENSE_CASES))] == [",".join(licences) for _, licences in LICENSE_CASES]


def test_every_license_rule_names_known_phrases(spark):
    known = {name for name, _ in licenses.PHRASES} | {"m_" + name for name, *_ in licenses.GNU}
    assert {i for _, ids in licenses.RULES for i in ids} <= known
    rows = [(1, "Words. Neither the name of Them may be used to endorse or promote products."), (2, "No words of a licence.")]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["bsd_names"], 2: []}


def test_main_text_keeps_the_article_whatever_wraps_it(spark):
    method = "<h2>Method</h2><p>{0} was measured.</p><h2>Results</h2><p>{0} is fine.</p>"
    rows = [(1, "http://a/1", '<div class="site has-sidebar"><article><p>One</p></article></div>', ["One"]),
            (2, "http://b/1", '<div id="sidebar"><main><p>Two</p><div class="comments"><article><p>no</p></article></div></main></div>', ["Two"]),
            (3, "http://c/1", '<article><header class="entry-header"><h1>Title</h1><p>by me</p></header><p>Three</p></article>', ["Title", "Three"]),
            (4, "http://d/1", '<article><div class="post-header"><h1>Title</h1></div><p>Four</p><article class="comment"><p>no</p></article></article>', ["Title", "Four"]),
            (5, "http://e/1", '<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article><div class="cookie-banner">no</div>', ["So x=1."]),
            (6, "http://f/1", f"<article>{method.format('Iron')}<h2>Offers</h2><p>Buy.</p></article>", ["Method", "Iron was measured.", "Results", "Iron is fine."]),
            (7, "http://f/2", f"<article>{method.format('Gold')}<h2>Offers</h2><p>Buy.</p></article>", ["Method", "Gold was measured.", "Results", "Gold is fine."])]
    got = {r["page_id"]: r["text"].split("\n\n") for r in pages.main_text(
        spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[3] for r in rows}
    assert pages.marks("site has-sidebar entry-header") == set() and pages.marks("site-header ad-slot") == {"header", "ad"}


def test_chat(spark):
    odd = "</s>[INST] \\<|end|>\\[ ok \\\\ [/INST]<|start|>user<|message|>"
    rows = [(1, 0, "user", odd, "z"), (1, 1, "assistant", odd, "z"), (1, 2, "assistant", None, "z"), (2, 0, None, "é😀", "z"), (2, 0, None, "é😀", "z"),
            (3, None, "assistant", "", "z"), (None, 1, "user<|message|>", "q", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                                                chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in (1, 2, 3, None):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t["role"], t["content"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for role, x in turns if role == "assistant")
    parts = [("text", "see [", None, None), ("image", None, "a.png", 196), ("document", None, "b.pdf", 3), ("audio", None, "c.wav", None), ("text", "end", None, None)]
    one = chat.format_chat(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert "see [\\<|image|><|document|><|audio|>end" in one["formatted"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [("image", "a.png", 196), ("document", "b.pdf", 768), ("audio", "c.wav", 1)]
    assert one["expanded_tokens"] == 965
    assert chat.format_chat(spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}")).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t in collected(docs))
    total, targets, taken = sum(r["size"] for r in got), {}, Counter()
    largest = max(r["size"] for r in got)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
        targets[(r["source_size"], r["target"])] = r["target"]
        taken[(r["source_size"], r["target"])] += r["taken"]
    assert sum(targets.values()) == pytest.approx(total)
    assert all(abs(taken[k] - t) <= largest / 2 + 1 for k, t in targets.items())
    assert Counter(map(tuple, mixing.mix_sources(docs).collect())) == Counter(map(tuple, got))
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_meets_targets_among_equal_rows(spark):
    rows_ = [(7, "w " * 10, "a")] * 100 + [(None, "w " * 10, "b")] * 100
    got = mixing.mix_sources(spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(3)).collect()
    for source, target in ((7, 2000 / 3), (None, 4000 / 3)):
        mine = [r for r in got if r["doc_id"] == source]
        assert len(mine) == 100 and abs(mine[0]["target"] - target) < 1e-6
        assert abs(sum(r["taken"] for r in mine) - target) <= 5 and max(r["repeats"] for r in mine) <= 3


def test_water_filling(spark):
    rows = [(10, 1), (1000, 2), (1, 3), (0, 1), (500, 2)]
    got = mixing.water_fill(spark.createDataFrame(rows, "size long, weight long")).collect()
    assert sum(r["target"] for r in got) == pytest.approx(1511)
    free = [r["target"] / r["weight"] for r in got if r["target"] < 3 * r["size"]]
    assert max(free) == pytest.approx(min(free)) and all(3 * r["size"] / r["weight"] <= free[0] for r in got if r["target"] == 3 * r["size"])


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    for _ in range(400):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        shared = sorted(pages.shared_lines(a, b))
        it = iter(b)
        assert len(shared) == lcs(a, b) and all(a[i] in it for i in shared)


def test_pages(spark):
    whole = ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div>"
             "<article><header>by me<h1>A &amp; B</h1></header><p>one <b>two<br>three</p><p>  four\n&nbsp;five</p><section id='comments'><p>reader</p></section></article>"
             "<footer>foot</footer></body></html>")
    plain = "<div>Menu of site</div><div>Story {0} told</div><p>More {0}</p><div>Terms of use</div>"
    rows = [(1, "http://a.com/x/1", whole), (2, "http://a.com/x/2", whole), (3, "http://b.com/n/1", plain.format("one")), (4, "HTTP://B.com/n/2?q", plain.format("two")),
            (5, None, plain.format("three")), (6, "http://c.com/", None), (7, "nohost", ""), (1, "http://a.com/x/1", whole), (None, "http://d.com/", "<p>a<p>b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    article = "A & B\n\none two three\n\nfour five"
    want = Counter({(1, article): 2, (2, article): 1, (3, "Story one told\n\nMore one"): 1, (4, "Story two told\n\nMore two"): 1,
                    (5, "Menu of site\n\nStory three told\n\nMore three\n\nTerms of use"): 1, (6, ""): 1, (7, ""): 1, (None, "a\n\nb"): 1})
    for shard in (256, 1):
        got = pages.main_text(df, shard=shard).collect()
        if shard == 256:
            assert Counter((r["page_id"], r["text"]) for r in got) == want
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert pages.main_text(df.where("false")).count() == 0


def test_differencing_decides_lines_of_articles(spark):
    told = "<p>{0} was told at some length</p><p>and {0} again</p>"
    page = "<article><h1>Story {0}</h1><p>Read us daily.</p>" + told + "</article>"
    rows = [(1, "http://a.com/1", page.format("one")), (2, "http://a.com/2", page.format("two")),
            (3, "http://b.com/1", page.format("three")), (4, "http://b.com/2", page.format("three")),  # copies
            (5, "http://c.com/1", page.format("five")),  # and one told in part
            (6, "http://c.com/2", "<main>" + told.format("five") + "<p>" + "Much more. " * 20 + "</p></main>")]
    got = {r["page_id"]: r["text"].split("\n\n") for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, name in ((1, "one"), (2, "two")):
        assert got[i] == [f"Story {name}", f"{name} was told at some length", f"and {name} again"]
    assert got[3] == got[4] == ["Story three", "Read us daily.", "three was told at some length", "and three again"]
    assert got[5] == ["Story five", "Read us daily.", "five was told at some length", "and five again"] and len(got[6]) == 3


def test_pages_are_paired_with_the_nearest_of_a_large_host(spark):
    # a section's notice is shared by the two pages of the section only
    html = "<div>Notice of section {0}</div><p>Story {1}</p>"
    rows = [(2 * k + h, f"http://a.com/s{k:04}/{h}", html.format(k, 2 * k + h)) for k in range(200) for h in (0, 1)]
    # pages of one path, told apart by the query only; neighbours share every line but the story
    rows += [(1000 + k, f"http://b.com/view?id={k:04}", html.format("b", 1000 + k)) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for shard in (pages.SHARD, 3, 1):
        assert {r["page_id"]: r["text"] for r in pages.main_text(df, shard=shard).collect()} == {r[0]: f"Story {r[0]}" for r in rows}


def test_pages_of_one_path_are_cut_into_ranges(spark, monkeypatch):
    rows = [(k, f"http://b.com/view?id={k // 2}", "<p>x") for k in range(4000)]
    seen = []
    monkeypatch.setattr(pages, "_neighbours", lambda ends, f=pages._neighbours: seen.append(ends) or f(ends))
    assert pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=100).count() == 4000
    keys = sorted((r[1], r[0]) for r in rows)
    assert len(seen[0]) >= 20 and seen[0][0][1][2] == keys[0][0] and seen[0][-1][2][2] == keys[-1][0]


def test_every_query_is_registered():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_loosely_chained_texts_are_not_compared_all_with_all(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    passages = [word(30) for _ in range(61)]
    texts = [" ".join(word(30) + passages[i] + word(30) + passages[i + 1]) for i in range(60)]
    texts += [t + " tail" for t in texts[::7]]
    # many near copies of each other in a list longer than those paired one by one, each a little further from the first
    base = word(150)
    texts += [" ".join(base[:150 - i] + word(i)) for i in range(52)]
    clusters = {}
    real = jaccard.written

    def seen(df, name):
        clusters[name] = out = real(df, name)
        return out

    monkeypatch.setattr(jaccard, "written", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.jaccard_join(docs).drop("set_key")
    assert Counter(tuple(r) for r in got.collect()) == brute_jaccard(list(enumerate(texts)))
    loose = {jaccard.set_key(s) for s in jaccard.shingle_sets([t.encode() for t in texts[:60]], 5)}
    assert not any(r["set_key"] in loose for r in clusters["clusters"].select("set_key").collect())
