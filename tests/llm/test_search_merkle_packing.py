"""Lexical search, Merkle manifest and best-fit packing against brute force: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sawmill.llm import lexical, merkle, packing

rnd = random.Random(11)
WORDS = ["".join(rnd.choice("abcdé1") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, item string, rank int, score long, term string, size long, root string, part int"


def say(n):
    return rnd.choice([" ", ", ", "\n", "--"]).join(rnd.choice(WORDS) for _ in range(n))


def rows():
    texts = [None, "", " ,.\n", "A", "a", "É é", "x" * 3000, say(4000), *(say(rnd.randint(1, 60)) for _ in range(60))]
    texts += [texts[20]] * 9  # ties
    docs = [(i * 3 % 101, t, rnd.choice(["de", "en", None, ""]), rnd.choice(["a", None]), rnd.choice([0, 7, None]), "i", "t", 5, 6, "t", 7, "r", 8)
            for i, t in enumerate(texts)]
    return [*docs, docs[9], docs[9], (None, say(5), None, None, None, "", "", 0, 0, "", 0, "", 0), (None, say(5), "en", "", 3, "", "", 0, 0, "", 0, "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


ITEMS = [(0, "a " + WORDS[3] + " " + WORDS[3]), (1, None), (2, "unseenterm"), (3, " ".join(WORDS[:25])), (4, "É"), (4, "É"), (None, WORDS[5]), (6, "--")]


@pytest.mark.parametrize("block, window", [(2 << 20, 1 << 20), (60, 16)])
def test_lexical_search(spark, docs, empty, monkeypatch, block, window):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)  # several automata
    monkeypatch.setattr(lexical, "WINDOW", window)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.lexical_search(docs, items, k=7)
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, 7)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == want
    assert lexical.lexical_search(empty, items).count() == 0
    assert lexical.lexical_search(docs, items.where("false")).columns == got.columns
    assert lexical.lexical_search(docs, items.where("text IS NULL")).count() == 0


def test_matches_are_whole_terms():
    found = lexical.Scanner(["a", "ab", "b", "é"]).scan("A ab,a b\x00aba É é".encode())
    assert found == (7, [0, 1, 0, 2, 3]) and lexical.Scanner(["a"]).scan(b"") == (0, [])


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """The top of a run of digests, and of each the siblings and their sides."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            if (other := place ^ 1) < len(nodes):
                paths[k].append((other < place, nodes[other]))
            else:
                paths[k].append(None)
        nodes, at = [h(nodes[i:i + 2]) for i in range(0, len(nodes), 2)], [a // 2 for a in at]
    return nodes[0], paths


def proven(leaf, path):
    for step in path:
        leaf = h([leaf] if step is None else [step[1], leaf] if step[0] else [leaf, step[1]])
    return leaf


def manifest(leaves):
    """leaves: (id, tree, leaf, claimed) -> the rows of the operator."""
    trees = {}
    for x in sorted(leaves, key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[3])):
        trees.setdefault(x[1], []).append(x)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    tops = {n: climb([x[2] for x in trees[n]]) for n in names}
    root, upper = climb([tops[n][0] for n in names])
    out = []
    for n, above in zip(names, upper):
        for x, path in zip(trees[n], tops[n][1]):
            path = path + above
            folded = proven(x[3], path)
            out.append((x[0], x[2], tops[n][0], root, h([s[1] for s in path if s]), folded, folded == root))
    return Counter(out)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_merkle_manifest(spark, docs, empty, height):
    leaves = docs.withColumn("leaf", merkle.document_leaf(F.col("n_chars"))).withColumn(
        "claimed", F.when(F.col("doc_id") % 5 == 0, merkle.document_leaf(F.col("n_chars") + 1)).otherwise(F.col("leaf")))
    rows_ = [(r["doc_id"], r["lang"], r["leaf"], r["claimed"]) for r in leaves.collect()]
    for r in docs.collect()[:5]:
        assert h(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")) in {x[2] for x in rows_}
    got = merkle.merkle_manifest(leaves, "lang", "doc_id", claimed="claimed", height=height)
    shown = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, shown)) == manifest(rows_)
    for r in got.collect()[:20]:
        assert merkle.fold(r["claimed"], r["proof"]) == r["folded_root"]
    one = merkle.merkle_manifest(leaves.where("doc_id = 0").limit(1), "lang", "doc_id", height=height).collect()
    assert len(one) == 1 and one[0]["root"] == one[0]["leaf"] == one[0]["subroot"] and one[0]["proof"] == "" and one[0]["verified"]
    assert merkle.merkle_manifest(leaves.where("false"), "lang", "doc_id").count() == 0


def test_token_pieces_and_packing(spark, docs, empty):
    t = Tokenizer.from_file(TOKENIZER)
    packed = packing.pack_documents(docs, TOKENIZER, capacity=100).cache()
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.update((r["doc_id"], p // 100, p, len(ids[p:p + 100]), np.array(ids[p:p + 100], "<u4").tobytes()) for p in range(0, len(ids), 100))
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in packed.collect())
    assert got == want
    whole = {r["sequence_id"]: r for r in packing.sequences(packed, 100).collect()}
    for r in packed.collect():
        s = bytes(whole[r["sequence_id"]]["ids"])
        assert s[4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"]) and len(s) <= 400
    assert sum(len(r["ids"]) for r in whole.values()) == 4 * sum(k[3] * n for k, n in want.items())
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


ODD = ["a", "B", "Z", "é", "É", "é", "H̱", "ẖ", "İ", "ß", "Σ", "'s", "'LL", "'", ".", ", ", ". ", "…", "!", "  ", "\n", "\xa0", " ", "\x1c",
       "\x0b", "\x85", "9", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "日本", "한", "😀", "‍", "ﬁ", "\x00", "×", "÷", "»", "$$"]


def test_ids_are_the_tokenizers():
    import pyarrow as pa
    t, words = Tokenizer.from_file(TOKENIZER), packing.Words(TOKENIZER)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(0, 12))) for _ in range(4000)] + ["", None]
    ids, n = words.encode(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert t.encode(text or "", add_special_tokens=False).ids == got.tolist(), repr(text)


@pytest.mark.parametrize("rows_, ranges", [(400, 1 << 16), (400, 40), (300, 7)])
def test_pack_needs_hardly_more_than_its_total(spark, rows_, ranges):
    rand = random.Random(rows_ + ranges)
    lengths = [rand.choice([rand.randint(1, 30), rand.randint(30, 400), 333, rand.randint(500, 1000), 1000]) for _ in range(rows_)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long").repartition(4)
    got = packing.pack(pieces, capacity=1000, range_rows=ranges)
    seats = {}
    for r in got.collect():
        seats.setdefault(r["sequence_id"], []).append((r["offset"], lengths[r["key"]]))
    assert sum(map(len, seats.values())) == rows_
    for s in seats.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1000
    assert len(seats) <= 1.03 * sum(lengths) / 1000 + 2
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, packing.pack(pieces.repartition(2), capacity=1000, range_rows=ranges).collect()))
    with pytest.raises(ValueError):
        packing.pack(pieces.selectExpr("key", "length + 1000 AS length"), capacity=1000)


def test_ranges_meet_by_rank():
    assert packing._meetings([(0, 3, 0), (1, 0, 2), (2, 1, 0), (3, 0, 5)]) == [(0, 0, 1, 0, 2), (2, 0, 3, 0, 1), (0, 2, 3, 1, 1)]


def test_a_worker_keeps_what_its_tasks_learned(monkeypatch):
    calls, real = [], packing.Words._ids
    monkeypatch.setattr(packing.Words, "_ids", lambda self, text: calls.append(text) or real(self, text))
    run = packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 1, 1024)
    rows = pa.record_batch([pa.array([1, 2]), pa.array(["Some words, anew xyzzyq.", "other words"])], names=["id", "text"])
    first = [b.to_pylist() for b in run(iter([rows]))]
    calls.clear()
    assert [b.to_pylist() for b in run(iter([rows]))] == first and not calls
