"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, exact check.

Equal vectors form a class first.  Each class is hashed in ``tables`` tables; a table concatenates two
cross-polytope hashes (index and sign of the largest coordinate after three rounds of random signs and
a fast Hadamard transform) and is probed in the ``probes`` buckets nearest to the vector.  A bucket compares
what lies in it with what probes it, by cosine in double precision; a pair that meets in several buckets
counts in the first only, which both vectors' codes tell.  A bucket of more than ``block`` rows is cut into
blocks, and every pair of its blocks is compared on its own: nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import bounded_batches, col, partitions, written
from sawmill.llm.components import components

COSINE = 0.9
TABLES = 12
PROBES = 4
BLOCK = 2048
SEED = 7
HOT_BROADCAST = 10_000  # rows
GROUP_ROWS = 100_000  # bucket entries that a task compares at a time, on average


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
        x = x.reshape(n, width)
    return x / np.sqrt(width)


def _ranked(x: np.ndarray, table: int, half: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The three nearest cross-polytope vertices of each row, and what each loses against the first."""
    width = x.shape[1]
    signs = np.random.default_rng([seed, table, half, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    top = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :3]
    value = np.take_along_axis(x, top, 1)
    return top + width * (value < 0), value[:, :1] ** 2 - value ** 2


def codes(unit: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """rows x tables x probes bucket codes, the home bucket first."""
    n, d = unit.shape
    width = 1 << max(2, (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = unit
    out = np.empty((n, tables, probes), np.int32)
    for t in range(tables):
        (a, la), (b, lb) = _ranked(x, t, 0, seed), _ranked(x, t, 1, seed)
        k = a.shape[1]
        loss = (la[:, :, None] + lb[:, None, :]).reshape(n, -1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(a, pick // k, 1) * (2 * width) + np.take_along_axis(b, pick % k, 1)
    return out


def _nodes(dtype):
    """id, embedding → id, node (hash of a valid vector, else null), the vector's bytes in its own precision."""
    def run(batches):
        for b in batches:
            nodes, blobs = [], []
            for v in b.column(1).to_pylist():
                x = np.array(v if v and None not in v else [], np.float64) + 0.0
                ok = len(x) and np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0
                blob = x.astype(dtype).tobytes() if ok else None
                nodes.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(blob)))) if ok else None)
                blobs.append(blob)
            yield pa.record_batch([b.column(0), pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())],
                                  names=["id", "node", "vec"])
    return run


def _coded(dtype, tables: int, probes: int, seed: int):
    def run(batches):
        for b in batches:
            node, vec, size = b.column("node").to_pylist(), b.column("vec").to_pylist(), b.column("size").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vec):
                by_dim.setdefault(len(v), []).append(i)
            for at in by_dim.values():
                x = np.frombuffer(b"".join(vec[i] for i in at), dtype).reshape(len(at), -1).astype(np.float64)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                c = codes(x, tables, probes, seed)
                yield pa.record_batch([pa.array([node[i] for i in at], pa.int64()), pa.array([size[i] for i in at], pa.int64()),
                                       pa.array([vec[i] for i in at], pa.binary()), pa.array([y.tobytes() for y in c], pa.binary()),
                                       pa.array([y.ravel().tolist() for y in c], pa.list_(pa.int32()))],
                                      names=["node", "size", "vec", "code", "flat"])
    return run


def _first_meeting(ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (a before b): the first table in which they meet, and whether in a's home bucket."""
    in_a = (cb == ca[:, :, :1]).any(2)  # b's probes hold a's home
    in_b = (ca == cb[:, :, :1]).any(2)
    first = np.argmax(in_a | in_b, axis=1)
    return first, in_a[np.arange(len(first)), first]


def _pairs(dtype, tables: int, probes: int, cosine: float):
    """The rows of many buckets → links of each node and a forest of edges, bucket by bucket."""
    def run(group):
        table = group.column("table").to_numpy()
        bucket = np.stack([group.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
        order = np.lexsort((group.column("node").to_numpy(), *bucket.T[::-1]))
        bucket, table = bucket[order], table[order]
        node, size = group.column("node").to_numpy()[order], group.column("size").to_numpy()[order]
        home, mine = group.column("home").to_numpy(zero_copy_only=False)[order], group.column("mine").to_numpy()[order]
        vec, code = group.column("vec").to_pylist(), group.column("code").to_pylist()
        ends = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]).any(1), True])
        links: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if hi - lo < 2 or not home[lo:hi].any():
                continue
            x = np.frombuffer(b"".join(vec[k] for k in order[lo:hi]), dtype).reshape(hi - lo, -1).astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            hit = np.triu((x @ x.T) / norm[:, None] / norm[None, :] >= cosine, 1)
            h, m = home[lo:hi], mine[lo:hi]
            hit &= h[:, None] | h[None, :]
            if bucket[lo, 1] != bucket[lo, 2]:
                hit &= m[:, None] != m[None, :]
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            c = np.frombuffer(b"".join(code[k] for k in order[lo:hi]), np.int32).reshape(hi - lo, tables, probes)
            names, weight = node[lo:hi], size[lo:hi]
            total = np.zeros(hi - lo, np.int64)
            for s in range(0, len(a), 100_000):
                p, q = a[s:s + 100_000], b[s:s + 100_000]  # names ascend, so p is the smaller node
                first, at_p = _first_meeting(c[p], c[q])
                counts = (first == table[lo]) & np.where(at_p, h[p], h[q])
                counts &= np.where(at_p, c[p, first, 0], c[q, first, 0]) == _code(bucket[lo, 0])
                np.add.at(total, p[counts], weight[q[counts]])
                np.add.at(total, q[counts], weight[p[counts]])
            for k in np.flatnonzero(total):
                links[int(names[k])] = links.get(int(names[k]), 0) + int(total[k])
            label, both = np.arange(hi - lo), hit | hit.T
            while True:
                least = np.minimum(label, np.where(both, label[None, :], hi - lo).min(1))
                if (least == label).all():
                    break
                label = least
            edges |= {(int(names[k]), int(names[label[k]])) for k in np.flatnonzero(label != np.arange(hi - lo))}
        rows = [(k, None, v) for k, v in links.items()] + [(x, y, 0) for x, y in edges]
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()),
                         "links": pa.array([r[2] for r in rows], pa.int64())})
    return run


def _code(bucket: np.int64) -> int:
    return int(bucket) & 0xFFFFFFFF


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, cosine: float = COSINE,
                 tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    ``n_links`` counts the other rows whose cosine is at least ``cosine``, ``component_id`` is the smallest id
    reachable by such links, ``kept`` tells rows whose id is their component's.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are kept.
    Vectors of different lengths never link.  Repeated rows and equal ids are separate rows of one class.
    Null ids are ignored as smallest id.  An empty table gives an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = vectors.select(col(id_col).alias("id"), col(vec_col).alias("vec"))
    long = T.LongType()
    held = base.schema["vec"].dataType
    dtype = np.float32 if isinstance(getattr(held, "elementType", None), T.FloatType) else np.float64
    rows = written(base.mapInArrow(_nodes(dtype), T.StructType([
        T.StructField("id", base.schema["id"].dataType), T.StructField("node", long), T.StructField("vec", T.BinaryType())])), "vectors")
    classes = (rows.where("node IS NOT NULL").groupBy("node")
               .agg(F.count(F.lit(1)).alias("size"), F.min("vec").alias("vec")))
    # few rows of much work each: dealt out evenly first
    coded = written(classes.repartition(partitions(spark)).mapInArrow(
        _coded(dtype, tables, probes, seed), "node long, size long, vec binary, code binary, flat array<int>"), "coded")
    placed = coded.select("node", "size", "vec", "code", F.posexplode("flat").alias("at", "code_at")).select(
        "node", "size", "vec", "code", (F.col("at") / probes).cast("int").alias("table"), (F.col("at") % probes == 0).alias("home"),
        F.octet_length("vec").alias("bytes"), F.col("code_at"))
    # table, length and code in one number
    bucket = (F.shiftleft(F.col("bytes").cast("long"), 40) + F.shiftleft(F.col("table").cast("long"), 32) + F.col("code_at")).alias("bucket")
    placed = placed.select("node", "size", "vec", "code", "table", "home", bucket)
    hot = written(placed.groupBy("bucket").count().where(F.col("count") > block)
                  .select(F.col("bucket").alias("_b"), F.ceil(F.col("count") / block).alias("blocks")), "hot")
    # groups of bounded size, however many rows there are
    parts = max(4 * partitions(spark), coded.count() * tables * probes // GROUP_ROWS)
    few = hot.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST
    joined = placed.join(F.broadcast(hot) if few else hot, F.col("bucket") == F.col("_b"), "left")
    mine = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1).cast("long")))
    cut = (joined.withColumn("mine", mine)
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)))
           .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
           .withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(parts))))
    found = written(cut.select("part", "bucket", "i", "j", "mine", "table", "home", "node", "size", "vec", "code")
                    .groupBy("part").applyInArrow(_pairs(dtype, tables, probes, cosine), "a long, b long, links long"), "found")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "_a")
    label = components(found.where("b IS NOT NULL").select("a", "b"), "vector-links").withColumnRenamed("id", "_i")
    told = (classes.select("node", "size").join(links, F.col("node") == F.col("_a"), "left")
            .join(label, F.col("node") == F.col("_i"), "left")
            .select(F.col("node").alias("_node"), "size", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
                    F.coalesce("component", "node").alias("label")))
    members = rows.select("id", "node").join(told, F.col("node") == F.col("_node"), "left")
    first = (members.where("label IS NOT NULL").groupBy("label", F.negative("label").alias("_x"))
             .agg(F.min("id").alias("first")).select(F.col("label").alias("_l"), "first"))
    root = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("first"))
    return (members.join(first, F.col("label") == F.col("_l"), "left")
            .select(F.col("id").alias(id_col), F.coalesce(F.col("size") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
                    root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept")))
