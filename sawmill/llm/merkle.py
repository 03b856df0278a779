"""Merkle manifest of a table by time-forward processing.

Leaves of a tree are ranked by a range sort.  A node's label is (level, position); every two consecutive
nodes become their parent until one node is left, the last run of a level being shorter where the level is
odd.  Time-forward processing delivers a node's digest to its parent's label: a
priority queue ordered by label hands each node the digests sent to it once all of them are there.

The queue is external.  Spark's shuffle is its outer part: nodes are delivered by (tree, position div
2 ** ``HEIGHT``), and the label's upper part decides the task.  Inside such a block, of bounded size
whatever the tree, a heap ordered by label is its inner part.  The tops of the blocks are the nodes
of the next round, 4,096 times fewer.  The reversed sweep runs back through the rounds: each block
gets the proof suffix of its top, and delivers it down to its leaves, every node adding its sibling.

Every round's nodes are written to the shared folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sawmill.llm.common import col, partitions, written

HEIGHT = 12  # levels of a block: 4,096 leaves


def digest(texts: list[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def encoded_field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded_field, values)).cast("binary"), 256)


def levels_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def sweep_up(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of all levels of a block, its leaves first: messages are taken from the queue by label."""
    out = [[] for _ in range(levels + 1)]
    queue = [(0, at, 0, d) for at, d in enumerate(digests)]  # (level, position, side, digest): already a heap
    while queue:
        level, at, _, d = heapq.heappop(queue)
        told = [d]
        while queue and queue[0][:2] == (level, at):
            told.append(heapq.heappop(queue)[3])
        own = told[0] if level == 0 else digest(told)
        out[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, at >> 1, at & 1, own))
    return out


def sweep_down(nodes: list[list[str]], suffix: str) -> Iterator[str]:
    """The proof of each leaf of a block, from the proof ``suffix`` of its top: a side (L, R, or N for none) and
    the sibling's digest, for every level.  The queue is ordered by label from the top down."""
    levels = len(nodes) - 1
    queue = [(0, 0, suffix)]  # (steps below the top, position, suffix)
    while queue:
        down, at, suffix = heapq.heappop(queue)
        level = levels - down
        if level == 0:
            yield suffix
            continue
        below = nodes[level - 1]
        left, right = 2 * at, 2 * at + 1
        if right < len(below):
            heapq.heappush(queue, (down + 1, left, f"R{below[right]}{suffix}"))
            heapq.heappush(queue, (down + 1, right, f"L{below[left]}{suffix}"))
        else:
            heapq.heappush(queue, (down + 1, left, f"N{suffix}"))


def siblings(proof: str) -> Iterator[tuple[str, str]]:
    """(side, digest) from the leaf's level up; the digest of N is empty."""
    at = 0
    while at < len(proof):
        size = 0 if proof[at] == "N" else 64
        yield proof[at], proof[at + 1:at + 1 + size]
        at += 1 + size


def fold(leaf: str, proof: str) -> str:
    """The root that follows from a leaf and its siblings."""
    for side, d in siblings(proof):
        leaf = digest([d, leaf] if side == "L" else [leaf, d])
    return leaf


def _tops(height: int):
    """The nodes of one block -> its top."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        n = group.column("nodes")[0].as_py()
        top = sweep_up(group.column("digest").to_pylist(), min(height, levels_of(n)))[-1]
        return pa.table({"tree": group.column("tree").slice(0, 1), "pos": group.column("block").slice(0, 1), "digest": pa.array(top),
                         "nodes": pa.array([-(-n // (1 << height))], pa.int64())})
    return run


def _suffixes(height: int, leaves: bool):
    """The nodes of one block and the proof suffix of its top -> their proofs; of ``leaves`` what they prove."""
    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        nodes = sweep_up(group.column("digest").to_pylist(), min(height, levels_of(group.column("nodes")[0].as_py())))
        proofs = list(sweep_down(nodes, above.column("suffix")[0].as_py()))
        subroot = pa.array([above.column("subroot")[0].as_py()] * len(group), pa.string())
        if not leaves:
            return pa.table({"tree": group.column("tree"), "pos": group.column("pos"), "suffix": pa.array(proofs, pa.string()), "subroot": subroot})
        return pa.table({"row": group.column("row"), "subroot": subroot, "proof": pa.array(proofs, pa.string()),
                         "proof_sha256": pa.array([digest([d for _, d in siblings(p)]) for p in proofs]),
                         "folded_root": pa.array([fold(x, p) for x, p in zip(group.column("claimed").to_pylist(), proofs, strict=True)])})
    return run


def ranked(rows: DataFrame, tree: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, within its tree by ``order``) and ``nodes`` (rows of its tree): a range sort,
    then running numbers from the counts of each range and tree."""
    spark = rows.sparkSession
    placed = (rows.repartitionByRange(partitions(spark), tree, *order).sortWithinPartitions(tree, *order)
              .withColumn("_range", F.spark_partition_id()).withColumn("_seen", F.monotonically_increasing_id()))
    placed = written(placed, name)
    counts = placed.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_r")).agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_tree = Window.partitionBy("_tree")  # a row per range at most
    before = F.sum("_n").over(of_tree.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_tree", "_r", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(of_tree).alias("nodes"))
    return (placed.join(counts, (F.col(tree) == F.col("_tree")) & (F.col("_range") == F.col("_r")))
            .withColumn("pos", F.col("_seen") - F.col("_first") + F.col("_before")).drop("_tree", "_r", "_first", "_before", "_range", "_seen"))


NODE = "tree string, pos long, digest string, nodes long"
PROOF = "tree string, pos long, suffix string, subroot string"


def _rise(nodes: DataFrame, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round with their blocks, and the single node left of each tree."""
    rounds, spare = [], 0
    while True:
        nodes = written(nodes.withColumn("block", F.shiftright("pos", height)), f"{name}-{len(rounds)}")
        if (nodes.agg(F.max("nodes")).first()[0] or 0) <= 1:
            return rounds, nodes
        rounds.append(nodes)
        nodes = nodes.select("tree", "pos", "digest", "nodes", "block").groupBy("tree", "block").applyInArrow(_tops(height), NODE)


def _fall(rounds: list[DataFrame], suffixes: DataFrame, height: int) -> DataFrame:
    """Proof suffixes and subroots (``PROOF``) of the single nodes -> those of the nodes of the first round."""
    for nodes in reversed(rounds):
        suffixes = (nodes.select("tree", "block", "pos", "digest", "nodes").groupBy("tree", "block")
                    .cogroup(suffixes.groupBy("tree", "pos")).applyInArrow(_suffixes(height, False), PROOF))
    return suffixes


def merkle_manifest(leaves: DataFrame, tree: str, id_col: str, leaf: str = "leaf", claimed: str | None = None, *,
                    height: int = HEIGHT, proofs: bool = True) -> DataFrame:
    """``leaves`` with ``subroot``, ``root``, ``proof``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``leaf`` holds the leaf's digest (64 hex digits), ``claimed`` (``leaf`` itself by default) the digest to verify.
    Leaves of one ``tree`` value ascend by ``id_col``, nulls first, ties by digest; rows that are equal in all of these get
    their places in any order, which changes no digest.  Trees are ordered by their value as text, bytewise, null first, and their tops
    form the upper tree in the same way; a lone leaf is its tree's top and a lone top the root.  ``proof`` lists the siblings up to the root:
    ``L`` or ``R`` and the digest, or ``N`` where a run has no other; ``proof_sha256`` hashes the digests alone.
    ``verified`` tells whether ``folded_root``, from ``claimed`` and the siblings, is the root.
    An empty table gives an empty result.  Columns beyond those named are carried along; the names above, if there, are replaced.
    """
    told = ("subroot", "root", "proof", "proof_sha256", "folded_root", "verified")
    rows = written(leaves.drop(*told).withColumn("_row", F.monotonically_increasing_id()), "leaves")
    name = F.when(col(tree).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), col(tree).cast("string")))  # null sorts first
    base = rows.select("_row", name.alias("tree"), col(id_col).alias("id"), col(leaf).alias("digest"), col(claimed or leaf).alias("claimed"))
    placed = ranked(base, "tree", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("claimed"), F.col("_row")], "ranked")
    rounds, tops = _rise(placed.select(F.col("_row").alias("row"), "claimed", "tree", "pos", "digest", "nodes"), height, "rise")
    leaf_nodes = rounds[0] if rounds else tops
    upper = ranked(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", [F.col("name")], "subroots")
    upper_rounds, top = _rise(upper.select("tree", "pos", "digest", "nodes"), height, "rise-upper")
    empty = F.lit("")
    proved = _fall(upper_rounds, top.select("tree", "pos", empty.alias("suffix"), empty.alias("subroot")), height)
    named = upper.select(F.col("name").alias("tree"), F.col("pos").alias("_pos"), F.col("digest").alias("subroot"))
    proved = written(named.join(proved.select("pos", "suffix"), F.col("_pos") == F.col("pos"))
                     .select("tree", F.lit(0).cast("long").alias("pos"), "suffix", "subroot"), "proved")
    above = _fall(rounds[1:], proved, height)
    shown = (leaf_nodes.select("tree", "block", "pos", "digest", "nodes", "row", "claimed").groupBy("tree", "block").cogroup(above.groupBy("tree", "pos"))
             .applyInArrow(_suffixes(height, True), "row long, subroot string, proof string, proof_sha256 string, folded_root string"))
    if not proofs:
        shown = shown.drop("proof")
    root = top.select("digest").first()  # one row, or none
    return (rows.join(shown, F.col("_row") == F.col("row")).drop("row", "_row")
            .withColumn("root", F.lit(root and root[0]).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root")))


def document_leaf(n_chars: Column) -> Column:
    """The leaf of a row of ``documents``."""
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))


ORACLE = """
WITH RECURSIVE field AS (
    SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
           CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
           list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: list_transform(range(8), lambda b: (ascii(c)::BIGINT >> b) & 1)))]),
               lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) AS crc
    FROM documents),
leaf AS (
    SELECT r, doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN
               sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END || tail)
           ELSE sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) END AS claimed
    FROM field),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claimed, r) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n, coalesce('=' || lang, '-') AS tree FROM leaf),
node AS (
    SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
    UNION ALL
    SELECT a.tree, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
    FROM node a LEFT JOIN node b ON b.tree = a.tree AND b.level = a.level AND b.pos = a.pos + 1
    WHERE a.n > 1 AND a.pos % 2 = 0),
subroot AS (
    SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
upper AS (
    SELECT 0 AS level, pos, n, digest FROM subroot
    UNION ALL
    SELECT a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
    FROM upper a LEFT JOIN upper b ON b.level = a.level AND b.pos = a.pos + 1
    WHERE a.n > 1 AND a.pos % 2 = 0),
climb AS (
    SELECT r, tree, level, pos, n, claimed AS folded, '' AS proof FROM (SELECT *, 0 AS level FROM placed)
    UNION ALL
    SELECT c.r, c.tree, c.level + 1, c.pos // 2, (c.n + 1) // 2,
           sha256(CASE WHEN s.digest IS NULL THEN c.folded WHEN c.pos % 2 = 0 THEN c.folded || s.digest ELSE s.digest || c.folded END),
           c.proof || coalesce(s.digest, '')
    FROM climb c LEFT JOIN node s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1)
    WHERE c.n > 1),
rise AS (
    SELECT c.r, 0 AS level, s.pos, s.n, c.folded, c.proof FROM climb c JOIN subroot s USING (tree) WHERE c.n = 1
    UNION ALL
    SELECT c.r, c.level + 1, c.pos // 2, (c.n + 1) // 2,
           sha256(CASE WHEN s.digest IS NULL THEN c.folded WHEN c.pos % 2 = 0 THEN c.folded || s.digest ELSE s.digest || c.folded END),
           c.proof || coalesce(s.digest, '')
    FROM rise c LEFT JOIN upper s ON s.level = c.level AND s.pos = xor(c.pos, 1)
    WHERE c.n > 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, u.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = u.digest AS verified
FROM placed p JOIN rise c USING (r) JOIN subroot s USING (tree) CROSS JOIN (SELECT digest FROM upper WHERE n = 1) u
WHERE c.n = 1
"""
