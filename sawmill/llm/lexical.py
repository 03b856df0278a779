"""Ranked lexical search: an Aho-Corasick automaton of all item terms scans whole documents.

No index of the documents is made.  Items (the queries) are dealt into blocks of bounded size; a
block's distinct terms become one automaton, which every task builds from a broadcast list.  Each term
stands between two guards (a separator on either side), so a match is always a whole term and at most one
term ends at any place of the text.

1. A first scan counts, per task and then over all, the documents that hold each term, the
   documents with any term and all their terms.
2. A second scan counts each term's occurrences in each document straight from the text; the automaton's
   outputs map to items through a table term -> (item, repeats), and a task keeps the best ``k``
   documents of each item.
3. The tasks' best are merged in two steps, so that no task reads more than a bounded share of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import bounded_batches, col, text_of, written
from sawmill.llm.words import texts

K = 20
BLOCK_BYTES = 2 << 20  # of item texts in one automaton
WINDOW = 1 << 20  # bytes of a document scanned at a time
SALTS = 256
#: Separators become a space and A-Z lower case; every byte from 0x80 on belongs to a term.
_NORMAL = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def windows(text: bytes) -> Iterator[bytes]:
    """The normalised text in parts that end between two terms."""
    data, at = text.translate(_NORMAL), 0
    while at < len(data):
        end = data.find(b" ", at + WINDOW) if at + WINDOW < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def terms_of(text: bytes) -> list[str]:
    return text.translate(_NORMAL).decode().split(" ")


class Scanner:
    """Counts the terms of a text, and finds those the automaton knows."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", i)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[int]]:
        n, found = 0, []
        for part in windows(text):
            n += len(part.split())
            found += map(itemgetter(1), self.automaton.iter(f" {part.decode()} "))
        return n, found


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """The items that have a term, with a block number: blocks hold ``BLOCK_BYTES`` at most, or a single item."""
    rows = written(items.where(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
                   .select("item", "text", F.monotonically_increasing_id().alias("row")), "items")
    size = F.octet_length("text") + 16
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    while n:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
        worst = dealt.groupBy("block").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.max("b")).first()[0]
        if (worst or 0) <= 2 * BLOCK_BYTES:
            return dealt, n
        n *= 2
    return rows.withColumn("block", F.lit(0)), 0


class Best:
    """The ``k`` best documents of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least, self.limit = k, np.ones(n_items, np.int64), max(1 << 17, 4 * k * n_items)
        self.got, self.held = [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.got.append((item, scores[row, item], null[row], ids[row]))
        self.held += len(row)
        if self.held > self.limit:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """item, score, null, id of the best, which alone are held from now on."""
        item, score, null, ids = (np.concatenate(x) for x in zip(*self.got, strict=True))
        order = np.lexsort((ids, null, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]
        keep = order[place < self.k]
        self.got, self.held = [tuple(x[keep] for x in (item, score, null, ids))], len(keep)
        return self.got[0]


def _count(terms):
    """text -> (term, number): documents that hold it; -1: documents with a term; -2: all their terms."""
    def run(batches):
        scanner, docs = Scanner(terms.value), Counter()
        for b in batches:
            for text in texts(b.column(0)):
                n, found = scanner.scan(text)
                docs.update(set(found))
                docs[-1] += n > 0
                docs[-2] += n
        yield pa.record_batch([pa.array(list(docs), pa.int64()), pa.array(list(docs.values()), pa.int64())], names=["term", "number"])
    return run


def _score(terms, plan, n_items: int, k: int):
    """id, text -> the task's best documents of each item."""
    def run(batches):
        scanner = Scanner(terms.value)
        weight, starts, item_of, repeats, n_docs, n_terms = plan.value
        posts = np.diff(starts)
        best, step = Best(n_items, k), max(1, min(256, (1 << 21) // n_items))
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                scanned = [scanner.scan(t) for t in texts(b.column(1))]
                n = [x for x, _ in scanned]
                doc = np.repeat(np.arange(len(n)), [len(found) for _, found in scanned])
                term = np.fromiter((t for _, found in scanned for t in found), np.int64, len(doc))
                key, tf = np.unique(doc * len(weight) + term, return_counts=True)
                doc, term = np.divmod(key, len(weight))
                m = np.array([75 + 25 * x * n_docs // n_terms for x in n], np.int64)
                part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                size = posts[term]
                post = np.repeat(starts[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                scores = np.zeros((len(n), n_items), np.int64)
                np.add.at(scores, (np.repeat(doc, size), item_of[post]), np.repeat(part, size) * repeats[post])
                ids = b.column(0).cast(pa.int64())
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        if best.held:
            item, score, null, ids = best.prune()
            yield pa.record_batch([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=null),
                                   pa.array(np.full(len(item), TaskContext.get().partitionId() % SALTS), pa.int32())],
                                  names=["item", "score", "id", "salt"])
    return run


def _search_block(docs: DataFrame, items: list, k: int, stats: tuple[int, int] | None) -> tuple[DataFrame, tuple[int, int]]:
    spark = docs.sparkSession
    held = [Counter(t for t in terms_of(text.encode()) if t) for _, text in items]
    names = sorted(set().union(*held))
    terms = spark.sparkContext.broadcast(names)  # of one block: bounded by its bytes
    counted = dict(docs.select("text").mapInArrow(_count(terms), "term long, number long").groupBy("term").agg(F.sum("number")).collect())
    n_docs, n_terms = stats or (counted.get(-1, 0), counted.get(-2, 0))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(i, 0) + 1))) for i in range(len(names))], np.int64)
    of = {t: i for i, t in enumerate(names)}
    post = sorted((of[t], i, r) for i, c in enumerate(held) for t, r in c.items())
    term, item, repeats = (np.array(x, np.int64) for x in zip(*post, strict=True))
    starts = np.searchsorted(term, np.arange(len(names) + 1))
    plan = spark.sparkContext.broadcast((weight, starts, item, repeats, n_docs, max(n_terms, 1)))
    best = docs.select(F.col("id").cast("long"), "text").mapInArrow(_score(terms, plan, len(items), k), "item long, score long, id long, salt int")
    for by in (("item", "salt"), ("item",)):
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item", "rank", "id", "score"), (n_docs, n_terms)


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                   item_id: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``id_col`` (long), ``score`` (long).

    Terms are the maximal runs of ASCII letters, digits and any character above U+007F, with A-Z
    lower-cased.  A term that N documents with a term and df holders give weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))); a document of n of the L terms has m = 75 + 25nN div L, and
    scores the sum of w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included.

    Only documents with a score above 0 are ranked; equal scores by ascending id, null ids last.  Ids are
    whole numbers.  Null and empty texts have no terms: such documents are never ranked, and such items
    have no rows.  Repeated documents are ranked each; each row of ``items`` is an item of its own, so a
    repeated row is answered twice.  An empty table of documents or items gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    dealt, n = _blocks(items.select(col(item_id).alias("item"), text_of(item_text).alias("text")))
    item_type = dealt.schema["item"].dataType
    out, stats = None, None
    for block in range(n):
        rows = dealt.where(F.col("block") == block).orderBy("row").select("item", "text").collect()  # bounded by BLOCK_BYTES
        if not rows:
            continue
        best, stats = _search_block(base, rows, k, stats)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType(
            [T.StructField("_item", T.LongType()), T.StructField(item_id, item_type)]))
        best = best.join(F.broadcast(names), F.col("item") == F.col("_item")).select(item_id, "rank", F.col("id").alias(id_col), "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(item_id, item_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())]))
    return out


ORACLE = r"""
WITH lowered AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
found AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM lowered),
sized AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM found WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM sized),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
wanted AS (
    SELECT item_id, term, count(*)::BIGINT AS r FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
    SELECT item_id, doc_id, sum(r * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
           * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // all_terms)))))::BIGINT AS score
    FROM wanted JOIN df USING (term) JOIN tf USING (term) CROSS JOIN totals GROUP BY ALL),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
