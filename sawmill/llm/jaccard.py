"""Exact n-gram Jaccard self-join over whole documents, by set relations.

A document's set holds its distinct word shingles, ordered by (frequent or not, hash): any order is
right for a prefix filter, and this one keeps common passages out of the prefixes.

1. Documents with equal sets form a class; one row per class goes on.
2. Index: each class lists the first ``n - ceil(t * n) + 1`` shingles of its set.  An index list is kept
   in blocks by size and by position (within the first ``n - ceil(2t / (1 + t) * n) + 1`` shingles or
   not); a block that is too small or too large for every set beside it, or in which no set has the
   shingle at such an early position, is skipped whole.  What is left of a list is chained, set to
   next larger set, which connects whatever can be linked with a number of edges linear in the
   list; the chains of a part are joined where they lie, and the components of all are the families.
3. Each family has a pivot, and every member's overlap with it is counted.  Members linked with the pivot
   are answered by that.  For the rest, and only for members that could reach one of them (distances
   to the pivot differ by at most 1 - t, the triangle inequality of the Jaccard distance), answers are
   derived from the pivot's: they are indexed once more among themselves, with all their shingles
   counted.  Sets that meet in a list of at most ``PAIRED`` entries are compared pair by pair, as many pairs
   as the lists name; longer lists are chained, and their clusters compared in blocks of bounded size.
4. Components of the links give each document its class id.

Index entries, shingle counts and texts travel packed, many to a row.  Nothing of the documents goes
to the driver but the ``frequent`` most frequent shingles, at most that many, which only shape
the order and never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import bounded_batches, col, lean, parts_for, text_of, written
from sawmill.llm.components import components, forest
from sawmill.llm.words import shingle_sets, texts

WIDTH = 5
PERCENT = 80
FREQUENT = 1 << 18
HOT = 8  # documents from which on a shingle counts as frequent
COUNTED = 0.35  # share of the hash range in which shingles are counted: prefixes come from its start
KEY_SHIFT = 28  # counts are kept by the upper 36 bits of a shingle's hash
PACK = 500_000  # entries a task gathers before it sends them on
PAIRED = 32  # entries of a list whose pairs are named one by one
KEPT = 256  # shingle sets a task keeps while it compares pairs
BLOCK = 512  # sets of a family compared at a time, and
BLOCK_SHINGLES = 1 << 19  # shingles of them, on average
FILTER_BITS = 1 << 27  # of a filter of set keys, at most
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def set_key(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _cells(parts: np.ndarray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions of its entries)."""
    order = np.argsort(parts, kind="stable")
    ends = np.searchsorted(parts[order], np.arange(n_parts + 1))
    for p in range(n_parts):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p]:ends[p + 1]]


def _sets(width: int):
    """id, text → id, number of shingles, set key (null for an empty set)."""
    def run(batches):
        for b in batches:
            sets = list(shingle_sets(texts(b.column(1)), width))
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())],
                                  names=["id", "n_shingles", "set_key"])
    return run


def _counts(width: int, n_parts: int, counted: float):
    """text → packed shingle counts by part of the counted hash range."""
    limit = np.uint64(min(int(counted * 2.0 ** 64), (1 << 64) - 1))
    span = (int(limit) >> KEY_SHIFT) // n_parts + 1

    def pack(got):
        keys, counts = np.unique(np.concatenate(got) >> np.uint64(KEY_SHIFT), return_counts=True)
        part = (keys // np.uint64(span)).astype(np.int64)
        rest = (keys - part.astype(np.uint64) * np.uint64(span)).astype(np.uint32)
        rows = [(p, rest[at].tobytes(), counts[at].astype(np.uint32).tobytes()) for p, at in _cells(part, n_parts)]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                                pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

    def run(batches):
        got, n = [], 0
        for b in batches:
            for s in shingle_sets(texts(b.column(0)), width):
                got.append(s[:np.searchsorted(s, limit, "right")])
                n += len(got[-1])
                if n >= PACK:
                    yield pack(got)
                    got, n = [], 0
        if n:
            yield pack(got)

    def merge(group):
        part = group.column("part")[0].as_py()
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()])
        distinct, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts).astype(np.int64)
        hot = total >= HOT
        return pa.table({"key": pa.array(distinct[hot].astype(np.int64) + part * span), "docs": pa.array(total[hot])})
    return run, merge


def _frequent(docs: DataFrame, width: int, limit: int, counted: float, n_parts: int) -> np.ndarray:
    """Sorted keys of at most ``limit`` most frequent shingles of the texts."""
    run, merge = _counts(width, n_parts, counted)
    packed = docs.mapInArrow(lean(run), "part int, keys binary, counts binary")
    top = (packed.groupBy("part").applyInArrow(merge, "key long, docs long")
           .orderBy(F.col("docs").desc(), "key").limit(limit))
    return np.sort(np.asarray(top.select("key").toArrow().column(0).to_numpy(), np.uint64))


def _families(docs: DataFrame, width: int, percent: int, limit: int, counted: float, name: str, n_parts: int) -> DataFrame:
    """(``_id``, ``_family``) of the sets of the texts (one column) that chains connect with others."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_frequent(docs, width, limit, counted, n_parts))  # at most ``limit`` numbers
    run, edges, _ = _index(width, percent, n_parts, shared)
    chains = docs.mapInArrow(lean(run), ENTRIES).groupBy("part").applyInArrow(edges, "a long, b long")
    return written(components(chains, name).select(F.col("id").alias("_id"), F.col("component").alias("_family")), name)


def _pairs(docs: DataFrame, width: int, percent: int, limit: int, name: str, n_parts: int) -> DataFrame:
    """(``a``, ``b``, ``chained``): the pairs of sets of the texts that meet in short lists, and the chains of long ones."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width, limit, 1.0, n_parts))
    run, _, pairs = _index(width, percent, n_parts, shared)
    return written(docs.mapInArrow(lean(run), ENTRIES).groupBy("part").applyInArrow(pairs, "a long, b long, chained boolean").distinct(), name)


def _texts_of(batches):
    """blob → text."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        yield pa.record_batch([pa.array([z.decompress(x) for x in b.column(0).to_pylist()], pa.binary()).cast(pa.string())], names=["text"])


ENTRIES = "part int, low binary, high binary, keys binary, sizes binary"


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the global order: frequent shingles last."""
    if not len(frequent):
        return s
    keys = s >> np.uint64(KEY_SHIFT)
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    hot = frequent[at] == keys
    return np.concatenate([s[~hot], s[hot]])


def _index(width: int, percent: int, n_parts: int, frequent):
    """text → packed index entries by part; and the edges of a part's lists."""
    def pack(got):
        token, key, size = (np.concatenate(x) for x in zip(*got, strict=True))
        h = token * _SPREAD
        part = ((h >> np.uint64(44)) % np.uint64(n_parts)).astype(np.int64)
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((h >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
        rows = [(p, *(x[at].tobytes() for x in (low, high, key, size))) for p, at in _cells(part, n_parts)]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32())] + [
            pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)], names=["part", "low", "high", "keys", "sizes"])

    def run(batches):
        got, n, seen = [], 0, set()
        for b in batches:
            for s in shingle_sets(texts(b.column(0)), width):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                if len(seen) > 200_000:  # a copy that is sent again is dropped by the reducer
                    seen.clear()
                m = len(s)
                prefix = ordered(s, frequent.value)[:m - -(-percent * m // 100) + 1]
                early = np.arange(len(prefix)) < m - -(-2 * percent * m // (100 + percent)) + 1
                got.append((prefix, np.full(len(prefix), key, np.int64), (np.uint32(m) << np.uint32(1)) | early.astype(np.uint32)))
                n += len(prefix)
                if n >= PACK:
                    yield pack(got)
                    got, n = [], 0
        if n:
            yield pack(got)

    def lists(group):
        """Keys, sizes, early or not, and run of the entries: a run is one list, each size within reach of the next."""
        read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in group.column(c).to_pylist()])
        token = read("low", np.uint32).astype(np.uint64) | (read("high", np.uint8).astype(np.uint64) << np.uint64(32))
        key, flags = read("keys", np.int64), read("sizes", np.uint32)
        size, early = (flags >> np.uint32(1)).astype(np.int64), (flags & np.uint32(1)).astype(bool)
        order = np.lexsort((key, size, token))
        token, key, size, early = token[order], key[order], size[order], early[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, size, early = token[new], key[new], size[new], early[new]
        start = np.ones(len(token), bool)
        start[1:] = (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])
        return key, size, early, start

    def chain(key, early, start):
        at = np.flatnonzero(start)
        useful = np.logical_or.reduceat(early, at) if len(at) else early
        run_of = np.cumsum(start) - 1
        link = np.flatnonzero(~start & useful[run_of])
        return forest(np.stack([key[link - 1], key[link]], 1)) if len(link) else np.empty((0, 2), np.int64)

    def edges(group):
        key, _, early, start = lists(group)
        pairs = chain(key, early, start)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    def pairs(group):
        """Pairs of short runs, the smaller set's entry an early one; and the chains of long runs."""
        key, size, early, start = lists(group)
        at = np.flatnonzero(start)
        length = np.diff(np.r_[at, len(key)])
        left = np.repeat(at + length, length) - np.arange(len(key)) - 1  # entries after this one in its run
        long = np.repeat(length > PAIRED, length)
        named = [np.empty((0, 2), np.int64)]
        rest = np.flatnonzero(~long & early & (left > 0))
        for gap in range(1, PAIRED):
            rest = rest[left[rest] >= gap]
            rest = rest[100 * size[rest] >= percent * size[rest + gap]]  # sizes ascend: what is out of reach stays so
            if not len(rest):
                break
            named.append(np.unique(np.sort(np.stack([key[rest], key[rest + gap]], 1), axis=1), axis=0))
        named = np.unique(np.concatenate(named), axis=0)
        chained = chain(key[long], early[long], start[long])
        both = np.concatenate([named, chained])
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64()),
                         "chained": pa.array(np.arange(len(both)) >= len(named))})
    return run, edges, pairs


def _key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of hashed keys, 16 for each key but ``FILTER_BITS`` at most: what isn't marked is not among them."""
    n = keys.count()
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    rows = (keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("pos"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("pos").alias("bits")).collect())  # 16 MB at most
    out = np.zeros(bits >> 3, np.uint8)
    for bucket, block in rows:
        out[(bucket - 1) << 12:((bucket - 1) << 12) + len(block)] = np.frombuffer(block, np.uint8)
    return out


def _xxhash64_of(keys: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one long (fixed values: the primes of XXH64; seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(keys), np.uint64(42) + p5 + np.uint64(8))
    h ^= turn(keys.view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _blobs(width: int, wanted):
    """text → set key and the compressed text, for the wanted keys (and a few others), once per task for equal sets."""
    def run(batches):
        seen, z = set(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            all_ = texts(b.column(0))
            keys = np.array([set_key(s) if len(s) else 0 for s in shingle_sets(all_, width)], np.int64)
            at = np.mod(_xxhash64_of(keys), np.int64(8 * len(wanted.value)))
            rows = []
            for i in np.flatnonzero(wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                if (key := int(keys[i])) not in seen:
                    seen.add(key)
                    if len(seen) > 200_000:  # a copy that is sent again is dropped later
                        seen.clear()
                    rows.append((key, z.compress(all_[i])))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()),
                                   pa.array([r[1] for r in rows], pa.binary())], names=["set_key", "blob"])
    return run


def _overlaps(width: int):
    """member and pivot blobs → sizes and overlap, the member's blob kept."""
    def run(batches):
        z, last, pivot = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            n, m, both = [], [], []
            sets = shingle_sets([z.decompress(x) for x in b.column("blob").to_pylist()], width)
            for s, theirs in zip(sets, b.column("pivot").to_pylist(), strict=True):
                if theirs != last:
                    last, pivot = theirs, next(shingle_sets([z.decompress(theirs)], width))
                n.append(len(s))
                m.append(len(pivot))
                both.append(len(np.intersect1d(s, pivot, assume_unique=True)))
            yield pa.record_batch([b.column("family"), b.column("set_key"), b.column("blob"),
                                   *(pa.array(x, pa.int64()) for x in (n, m, both))],
                                  names=["family", "set_key", "blob", "n", "pivot_n", "shared"])
    return run


def _links(width: int, percent: int):
    """Pairs with the blobs of both → those that link.  Some sets are kept, as pairs come by ``b``."""
    def run(batches):
        z, kept = zstandard.ZstdDecompressor(), {}

        def set_of(key, blob):
            if (got := kept.pop(key, None)) is None:
                got = next(shingle_sets([z.decompress(blob)], width))
            kept[key] = got  # the last one used comes last
            if len(kept) > KEPT:
                del kept[next(iter(kept))]
            return got

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for a, x, b, y in zip(*(c.to_pylist() for c in whole.slice(at, 256).select(["a", "blob_a", "b", "blob_b"]).columns), strict=True):
                    s, t = set_of(b, y), set_of(a, x)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        out.append((a, b))
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
    return run


def _compare(width: int, percent: int):
    """The links among one group of a family's sets, as a spanning forest of them."""
    def run(group):
        z = zstandard.ZstdDecompressor()
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("set_key", "linked", "distance", "blob")), strict=True))
        keys = [r[0] for r in rows]
        linked, far = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        sets = list(shingle_sets([z.decompress(r[3]) for r in rows], width))
        size = np.array([len(s) for s in sets])
        universe, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        mark, root, out = np.zeros(len(universe), bool), np.arange(len(keys)), []
        slack = 1 - percent / 100 + 1e-9
        for i in range(len(keys) - 1):
            later = np.arange(len(keys)) > i
            could = (later & (root != root[i]) & ~(linked & linked[i]) & (np.abs(far - far[i]) <= slack)
                     & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            if not could.any():
                continue
            own = ids[starts[i]:starts[i] + size[i]]
            mark[own] = True
            for j in np.flatnonzero(could):
                shared = int(np.count_nonzero(mark[ids[starts[j]:starts[j] + size[j]]]))
                if 100 * shared >= percent * (size[i] + size[j] - shared) and root[i] != root[j]:
                    out.append((keys[i], keys[j]))
                    root[root == root[j]] = root[i]
            mark[own] = False
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH,
                 percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``set_key``, ``component_id``.

    Words are the runs between white space, with A-Z lower-cased.  Two rows link when
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id reachable by links.

    A text of fewer words than ``width`` is one shingle; a null text and one without a word have an
    empty set (``set_key`` null), link with nothing and keep their own id.  Repeated rows and equal
    ids are rows of one class.  Null ids are ignored as smallest id: a component of null ids only has
    a null id.  An empty table gives an empty result.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    n_parts = parts_for(docs)
    base = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = base.schema["id"].dataType
    long = T.LongType()
    sets = written(base.mapInArrow(lean(_sets(width)), T.StructType(
        [T.StructField("id", id_type), T.StructField("n_shingles", long), T.StructField("set_key", long)])), "sets")

    families = _families(base.select("text"), width, percent, frequent, COUNTED, "chains", n_parts)

    wanted = docs.sparkSession.sparkContext.broadcast(_key_filter(families, "_id"))
    blobs = base.select("text").mapInArrow(lean(_blobs(width, wanted)), "set_key long, blob binary")
    members = written(blobs.join(families, F.col("set_key") == F.col("_id"))
                      .groupBy(F.col("_family").alias("family"), "set_key").agg(F.min("blob").alias("blob")), "members")
    pivots = members.where("family = set_key").select(F.col("family").alias("_f"), F.col("blob").alias("pivot"))
    told = members.join(pivots, F.col("family") == F.col("_f")).drop("_f").mapInArrow(
        lean(_overlaps(width)), "family long, set_key long, blob binary, n long, pivot_n long, shared long")
    union = F.col("n") + F.col("pivot_n") - F.col("shared")
    told = written(told.select("family", "set_key", "blob", "n",
                               (100 * F.col("shared") >= percent * union).alias("linked"),
                               (1 - F.col("shared") / union).alias("distance")), "told")
    stars = told.where("linked AND set_key != family").select(F.col("set_key").alias("a"), F.col("family").alias("b"))

    # what the pivot leaves open: members it isn't linked with, and linked ones that could reach them
    open_ = (told.groupBy("family").agg(F.min(F.when(~F.col("linked"), F.col("distance"))).alias("nearest"))
             .where("nearest IS NOT NULL").select(F.col("family").alias("_f"), "nearest"))
    rest = written(told.join(open_, F.col("family") == F.col("_f")).drop("_f")
                   .where(~F.col("linked") | (F.col("distance") >= F.col("nearest") - (1 - percent / 100) - 1e-9)), "rest")
    # these few are indexed once more, with all their shingles counted: what shares just passages parts
    met = _pairs(rest.select("blob").mapInArrow(_texts_of, "text string"), width, percent, frequent, "pairs", n_parts)
    facts = [rest.select(F.col("set_key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("family", "linked", "distance"))) for x in "ab"]
    near = F.abs(F.col("distance_a") - F.col("distance_b")) <= 1 - percent / 100 + 1e-9
    open_pairs = (met.where("NOT chained").join(facts[0], "a").join(facts[1], "b")
                  .where((F.col("family_a") == F.col("family_b")) & ~(F.col("linked_a") & F.col("linked_b")) & near).select("a", "b"))
    blob = [rest.select(F.col("set_key").alias(x), F.col("blob").alias(f"blob_{x}")) for x in "ab"]
    named = open_pairs.join(blob[0], "a").join(blob[1], "b").mapInArrow(lean(_links(width, percent)), "a long, b long")

    again = components(met.where("chained").select("a", "b"), "chains-again")
    again = written(again.select(F.col("id").alias("_id"), F.col("component").alias("cluster")), "chains-again")
    rest = written(rest.join(again, F.col("set_key") == F.col("_id")).drop("_id"), "clusters")
    key = ("family", "cluster")
    blocks = (rest.groupBy(*key).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
              .select(F.col("family").alias("_f"), F.col("cluster").alias("_c"), "blocks"))
    mine = F.pmod(F.xxhash64("set_key"), F.col("blocks"))
    placed = (rest.join(blocks, (F.col("family") == F.col("_f")) & (F.col("cluster") == F.col("_c")))
              .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")))
    # one column of its own, so that the blocks of a cluster are dealt out and do not stay where the cluster lies
    links = (placed.select(F.struct(*key, "i", "j").alias("cell"), "set_key", "linked", "distance", "blob").groupBy("cell")
             .applyInArrow(_compare(width, percent), "a long, b long")).unionByName(named)
    classes = components(stars.union(links), "links")

    labelled = (sets.join(classes.withColumnRenamed("id", "_id"), F.col("set_key") == F.col("_id"), "left")
                .select("id", "n_shingles", "set_key", F.coalesce("component", "set_key").alias("label")))
    first = (labelled.where("label IS NOT NULL").groupBy("label", F.negative("label").alias("_x")).agg(F.min("id").alias("first"))
             .select(F.col("label").alias("_l"), "first"))
    return (labelled.join(first, F.col("label") == F.col("_l"), "left")
            .select(F.col("id").alias(id_col), "n_shingles", "set_key",
                    F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("first")).alias("component_id")))
