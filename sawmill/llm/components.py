"""Connected components of a graph of any size, as Spark jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import lean, written

HELD = 1 << 20  # edges that a task joins at a time


def _with_min(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``_m``, the smallest ``value`` of their ``key``.

    Grouped by two columns but joined on one, so that the join deals both sides out anew and a key
    with many rows can be split.
    """
    least = (rows.groupBy(F.col(key), F.negative(key).alias("_n")).agg(F.min(value).alias("_m"))
             .select(F.col(key).alias("_k"), "_m"))
    return rows.join(least, F.col(key) == F.col("_k")).drop("_k")


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (id, smallest id of its component) that connect what ``pairs`` (rows of two longs) connect: stars, no more than the pairs."""
    ids, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        hi, lo = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        parted = hi != lo
        if not parted.any():
            break
        a, b = a[parted], b[parted]
        np.minimum.at(root, hi[parted], lo[parted])  # only roots are hung up, below smaller ones
        while not np.array_equal(root, up := root[root]):
            root = up
    leaf = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[leaf], ids[root[leaf]]], 1)


def _stars(batches):
    """Edges (``hi``, ``lo``) of a task → the ``forest`` of each ``HELD`` of them, in which what was held before goes on while it leaves room."""
    held, n = [], 0

    def joined():
        pairs = forest(np.concatenate(held))
        return pairs, pa.record_batch([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["hi", "lo"])

    for whole in batches:
        for at in range(0, whole.num_rows, HELD):
            b = whole.slice(at, HELD)
            held.append(np.stack([b.column(i).to_numpy() for i in (0, 1)], 1))
            n += b.num_rows
            if n >= HELD:
                pairs, out = joined()
                held, n = [pairs], len(pairs)
                if n > HELD // 2:
                    yield out
                    held, n = [], 0
    if n:
        yield joined()[1]


def _contracted(edges: DataFrame) -> DataFrame:
    """Distinct edges dealt out by hash, and in each task the stars that connect what its edges connect: no more than they are."""
    return edges.distinct().mapInArrow(lean(_stars), "hi long, lo long")


def _ends(edges: DataFrame, *ends: tuple[Column, Column], names: tuple[str, str]) -> DataFrame:
    """A row for each of ``ends``, pairs of columns, of every edge: planned once, where a union plans ``edges`` for each."""
    pairs = F.array(*(F.struct(*(c.alias(n) for c, n in zip(pair, names, strict=True))) for pair in ends))
    return edges.select(F.explode(pairs).alias("_end")).select(*(F.col(f"_end.{n}").alias(n) for n in names))


def _open(edges: DataFrame) -> bool:
    """Whether an id of the edges has two smaller neighbours, or a smaller and a larger one: else they are stars, each once."""
    of = (_ends(edges, (F.col("hi"), F.lit(1)), (F.col("lo"), F.lit(0)), names=("v", "up")).groupBy("v")
          .agg(F.sum("up").alias("up"), F.sum(1 - F.col("up")).alias("down")))
    return of.where("up > 1 OR (up > 0 AND down > 0)").agg(F.count(F.lit(1))).first()[0] > 0


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(``id``, ``component``) for every id of ``edges`` (``a``, ``b``: longs); the component is its smallest id.

    Tasks replace the edges they hold by stars, so that edges which a few tasks hold need few rounds or none.  What
    spans tasks takes alternating large-star and small-star rounds, until the edges are stars: each is two joins on
    the remaining edges, whose number never grows; rounds grow with the logarithm of the size.  Every round's edges
    are written to the shared folder.  Only a count reaches the driver, whose memory every round takes some of, by
    its plans, jobs and threads.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current = written(_contracted(pairs), name)
    hi, lo, least = F.col("hi"), F.col("lo"), F.col("_m")
    while _open(current):
        both = _ends(current, (hi, lo), (lo, hi), names=("v", "u"))
        large = _with_min(both, "v", "u").where("u > v").select(F.col("u").alias("hi"), F.least("_m", "v").alias("lo"))
        small = _with_min(large.distinct(), "hi", "lo")
        current = written(_contracted(_ends(small, (hi, least), (lo, least), names=("hi", "lo")).where("hi != lo")), name)
    roots = current.select("lo").distinct().select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    return current.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots)
