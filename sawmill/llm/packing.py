"""Best-fit packing of token sequences, bulk-synchronous: all documents look for their gap at once.

Texts become token ids; longer ones are cut into pieces of the capacity.  A piece of more than half the
capacity opens a sequence; what is left of a sequence is a gap.  Then rounds follow:

1. Range sort: pieces not yet placed and gaps are dealt by size into ranges of bounded size.  The ranges
   come from the histogram of sizes, which has at most as many rows as the capacity; a size that many
   rows share is split over several ranges.
2. Successor sweep: each range is swept upwards.  A gap takes the largest piece that waits below it, and
   further ones while they fit: the piece gets the smallest gap that holds it and isn't taken.
3. Conflicts over ranges: what a range leaves, waiting pieces and free gaps, is numbered by rank; from the
   two counts of each range follow the intervals of ranks that meet, and a join by (range, rank)
   places one piece in each such gap.
4. Gaps are updated, those too small for any piece are closed, new sequences are opened for
   what the gaps can't hold in total, and the next round begins, until every piece has a place.

Every round is written to the shared folder, which also ends its lineage.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sawmill.llm.common import bounded_batches, col, text_of, written
from sawmill.llm.words import texts

CAPACITY = 4096
RANGE_ROWS = 1 << 16  # pieces and gaps swept by one task
BROADCAST_ROWS = 100_000  # of the meetings of ranges; beyond it their join shuffles
SEGMENTS = 1 << 19  # distinct segments whose ids a worker keeps
JOINED = 1 << 20  # bytes of new words given to the tokenizer at a time
#: a-z, and the letters of U+00C0-U+00FF in UTF-8.
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_PLAIN = re.compile(rb"(?:[a-z]|%s)+" % _LATIN)
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<>")  # neither contractions nor special tokens
_MARKED = re.compile(rb"(.*(?:[a-z]|%s))[%s]+" % (_LATIN, re.escape(_MARKS)), re.DOTALL)
_BOUND = re.compile(rb"(?<![a-z0-9])(?<!%s)[.,;:!?] " % _LATIN)  # a mark that may belong to what is before it


def spaced(text: bytes) -> bytes:
    """``text`` with a space before each mark that a letter or digit precedes and a space follows, which parts no token.

    A-Z are lower-cased where that can't change the ids: names of special tokens stay, and so does a text with
    combining marks (U+0300-U+037F), since there are letters that compose with them in lower case only."""
    if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    if not _BOUND.search(text):
        for mark in (b". ", b", ", b"; ", b": ", b"! ", b"? "):
            text = text.replace(mark, b" " + mark)
    return text


class Words:
    """Token ids of whole texts.  White space never is part of a token of this tokenizer, so a text's ids are
    those of its segments between white space; nor does one reach over a word's end into a mark after it, so a
    segment's ids are those of its word and of the marks that end it.  Of these, new ones are encoded many at a time."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")

    def _words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words of letters alone, as one text: each one's ids end where a word ends."""
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size < JOINED):
                size += len(words[end]) + 1
                end += 1
            ids = self._ids(b" ".join(words[at:end]))
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == end - at:
                raw, start = ids.tobytes(), 0
                for w, e in zip(words[at:end], ends.tolist(), strict=True):
                    yield w, raw[start:e]
                    start = e
            else:
                yield from ((w, self._ids(w).tobytes()) for w in words[at:end])
            at = end

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of segments that aren't known."""
        cut = [(s, m.span(1)[1]) for s in new if s[-1:] in _MARKS and (m := _MARKED.fullmatch(s))]
        alone = {s for s in new}.difference(s for s, _ in cut)
        parts = alone.union(s[:n] for s, n in cut).union(s[n:] for s, n in cut).difference(self.known)
        plain = [p for p in parts if p.isalpha() or _PLAIN.fullmatch(p)]
        out = {p: self._ids(p).tobytes() for p in parts.difference(plain)}
        out.update(self._words(plain))
        look = lambda p: out[p] if p in out else self.known[p]
        out.update([(s, look(s[:n]) + look(s[n:])) for s, n in cut])
        self.known.update(islice(out.items(), max(0, SEGMENTS - len(self.known))))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        split = pc.ascii_split_whitespace(pa.array(list(map(spaced, texts(column))), pa.binary()).cast(pa.string()))
        segments = split.values.dictionary_encode()
        names = segments.dictionary.cast(pa.binary()).to_pylist()
        new = self._learn([s for s in names if s not in self.known])
        found = [self.known[s] if s in self.known else new[s] for s in names]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, which = np.cumsum(size) - size, segments.indices.to_numpy()
        n = size[which]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(start[which] - end[:-1], n) + np.arange(end[-1])]
        return ids, np.diff(end[split.offsets.to_numpy()])


@lru_cache(1)
def words_of(path: str) -> Words:
    """The one of this Python worker: what one task learned, its later tasks know."""
    return Words(path)


def _pieces(path: str, capacity: int, end_id: int, step: int):
    """id, text -> one row per piece: id, piece, start, length, ids."""
    def run(batches):
        words = words_of(path)
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                ids, n = words.encode(b.column(1))
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype("<u4").tobytes()
                n = n + 1
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(n[row] - number * capacity, capacity)
                end = np.cumsum(length) * 4
                cut = [ids[x:y] for x, y in zip((end - 4 * length).tolist(), end.tolist(), strict=True)]
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(number * capacity),
                                       pa.array(length), pa.array(cut, pa.binary())], names=["id", "piece", "start", "length", "ids"])
    return run


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *,
                 capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: ``id_col``, ``piece`` (from 0), ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit).

    A document is its token ids, without added special tokens, then ``end_id``; it is cut every ``capacity``
    ids.  A null or empty text is ``end_id`` alone.  Repeated rows and equal ids are pieces of their own.
    Whole texts are encoded.  An empty table gives no pieces.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = base.mapInArrow(_pieces(tokenizer, capacity, end_id, 1024), T.StructType([
        base.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]))
    return out.withColumnRenamed("id", id_col)


def _sweep(group: pa.Table) -> pa.Table:
    """One range, upwards: pieces wait, a gap takes the largest ones below it.

    Per row, ``seat`` is the gap a piece was put in and ``at`` the room that gap had then; for a gap, ``size``
    is the room it has left.  Rows that are left get a ``rank``: the last waiting piece and the first free gap are 0.
    """
    size, gap, name = (group.column(c).to_numpy() for c in ("size", "gap", "id"))
    order = np.lexsort((name, gap, size))
    size, gap, name = size[order].astype(np.int64), gap[order], name[order]
    n = len(size)
    seat, room, rank, taken = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, bool)
    waits, at = [], []  # lengths and rows of waiting pieces, ascending
    left, free = size.copy(), 0
    sizes, gaps = size.tolist(), gap.tolist()
    for i in range(n):
        if not gaps[i]:
            waits.append(sizes[i])
            at.append(i)
            continue
        still = sizes[i]
        while waits and (k := bisect_right(waits, still)):
            piece = at.pop(k - 1)
            seat[piece], room[piece] = i, still
            still -= waits.pop(k - 1)
            taken[i] = True
        left[i] = still
        if not taken[i]:
            rank[i] = free
            free += 1
    rank[at] = np.arange(len(at))[::-1]
    part = group.column("part")[0].as_py()
    return pa.table({"part": pa.array(np.full(n, part), pa.int64()), "gap": pa.array(gap), "id": pa.array(name),
                     "size": pa.array(left), "seat": pa.array(name[seat], mask=seat < 0),
                     "room": pa.array(room), "rank": pa.array(rank, pa.int64())})


def _meetings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range, waiting pieces, free gaps) in order -> (range of pieces, first rank, range of gaps, first rank, number):
    the free gaps of a range take the nearest pieces that wait in the ranges below."""
    out, stack = [], []
    for part, waiting, free in counts:
        taken = 0
        while free and stack:
            below, first, n = stack.pop()
            k = min(n, free)
            out.append((below, first, part, taken, k))
            taken, free = taken + k, free - k
            if k < n:
                stack.append((below, first + k, n - k))
        if waiting:
            stack.append((part, 0, waiting))
    return out


MEETING = "_part long, first long, gap_part long, gap_first long, number long"
STATE = ("gap", "id", "size")


def _ranges(sizes: Counter, rows: int) -> list[tuple[int, int, int]]:
    """(size, first range, number of ranges): ranges of about ``rows`` rows in the order of sizes."""
    seen, out = 0, []
    for size, n in sorted(sizes.items()):
        out.append((size, seen // rows, (seen + n - 1) // rows - seen // rows + 1))
        seen += n
    return out


def _round(state: DataFrame, sizes: Counter, rows: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``state`` (pieces and gaps: gap, id, size) -> placements (id, seat, room), and the state after them."""
    spark = state.sparkSession
    ranges = F.broadcast(spark.createDataFrame(_ranges(sizes, rows), "_size long, _first long, _n long"))  # a row per size
    dealt = (state.join(ranges, F.col("size") == F.col("_size"))
             .select(*STATE, (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_n"))).alias("part")))
    swept = written(dealt.groupBy("part").applyInArrow(
        _sweep, "part long, gap boolean, id long, size long, seat long, room long, rank long"), name)
    left = swept.where("rank >= 0")
    counts = left.groupBy("part").agg(F.count(F.when(~F.col("gap"), 1)), F.count(F.when(F.col("gap"), 1))).collect()  # a row a range
    meetings = _meetings(sorted(tuple(x) for x in counts))
    meet = spark.createDataFrame(meetings, MEETING)
    pieces = (left.where("NOT gap").join(F.broadcast(meet) if len(meetings) <= BROADCAST_ROWS else meet,
                                         (F.col("part") == F.col("_part")) & (F.col("rank") >= F.col("first"))
                                         & (F.col("rank") < F.col("first") + F.col("number")), "left")
              .select("id", "size", "gap_part", (F.col("gap_first") + F.col("rank") - F.col("first")).alias("gap_rank")))
    waiting = pieces.where("gap_part IS NULL").select(F.lit(False).alias("gap"), "id", "size")
    gaps = left.where("gap").select(F.col("id").alias("seat"), F.col("size").alias("room"), F.col("part").alias("_p"), F.col("rank").alias("_r"))
    met = written(gaps.join(pieces.where("gap_part IS NOT NULL"), (F.col("gap_part") == F.col("_p")) & (F.col("gap_rank") == F.col("_r")), "left")
                  .select("id", "size", "seat", "room"), f"{name}-met")
    placed = (swept.where("seat IS NOT NULL").select("id", "seat", "room")
              .unionByName(met.where("id IS NOT NULL").select("id", "seat", "room")))
    gaps = (swept.where("gap AND rank < 0").select(*STATE)
            .unionByName(met.select(F.lit(True).alias("gap"), F.col("seat").alias("id"), (F.col("room") - F.coalesce("size", F.lit(0))).alias("size"))))
    return placed, waiting.unionByName(gaps)


def pack(pieces: DataFrame, key: str = "key", length: str = "length", *, capacity: int = CAPACITY,
         range_rows: int = RANGE_ROWS) -> DataFrame:
    """Places of ``pieces`` in as few sequences of at most ``capacity`` as best fit needs: ``key``, ``sequence_id``
    (long, any numbers), ``offset`` (long, where the piece begins; a sequence has no holes before its end).

    ``key`` is a whole number from 0 that no other piece has; ``length`` is between 1 and ``capacity``, anything else is
    an error.  Pieces of equal length are placed by their keys, so a rerun agrees.  An empty table gives no places.  Other columns are not read.
    """
    spark = pieces.sparkSession
    rows = written(pieces.select(col(key).cast("long").alias("id"), col(length).cast("long").alias("size")), "pieces")
    if rows.where(f"size IS NULL OR size < 1 OR size > {capacity} OR id IS NULL OR id < 0").limit(1).count():
        raise ValueError(f"a piece is empty or longer than {capacity}, or lacks its key")
    big = f"2 * size > {capacity}"
    places = [rows.where(big).select("id", F.col("id").alias("seat"), F.lit(capacity).cast("long").alias("room"))]
    state = (rows.where(f"NOT {big}").select(F.lit(False).alias("gap"), "id", "size")
             .unionByName(rows.where(f"{big} AND size < {capacity}").select(F.lit(True).alias("gap"), "id", (capacity - F.col("size")).alias("size"))))
    opened, number, before = 0, 0, None
    while True:
        counts = state.groupBy("gap", "size").count().collect()  # two rows a size at most
        waiting = Counter({size: n for gap, size, n in counts if not gap})
        if not waiting:
            break
        least, total = min(waiting), sum(size * n for size, n in waiting.items())
        gaps = Counter({size: n for gap, size, n in counts if gap and size >= least})
        room = 0 if before == waiting else sum(size * n for size, n in gaps.items())  # if no gap helped, open sequences
        new = max(0, -(-(total - room) // capacity))
        state = state.where(f"NOT gap OR size >= {least}")
        if new:
            fresh = spark.range(opened + 1, opened + new + 1).select(F.lit(True).alias("gap"), (-F.col("id")).alias("id"),
                                                                     F.lit(capacity).cast("long").alias("size"))
            state = state.unionByName(fresh)
        placed, state = _round(state, waiting + gaps + Counter({capacity: new}), range_rows, f"round-{number}")
        places.append(placed)
        opened, number, before = opened + new, number + 1, waiting
    out = places[0]
    for x in places[1:]:
        out = out.unionByName(x)
    return out.select(F.col("id").alias(key), F.col("seat").alias("sequence_id"), (capacity - F.col("room")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY,
                   end_id: int = 1, digest: bool = False) -> DataFrame:
    """One row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids`` (with ``digest`` their ``ids_crc32`` instead),
    ``sequence_id``, ``offset``.  See ``token_pieces`` and ``pack`` for nulls, long texts, repeated rows and empty tables."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity=capacity, end_id=end_id)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    pieces = written(pieces.withColumn("_key", F.monotonically_increasing_id()), "token-pieces")
    places = pack(pieces, "_key", capacity=capacity)
    return pieces.join(places, "_key").drop("_key")


def _row(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("offset").to_numpy())
        ids, lens = group.column("ids").take(pa.array(order)), group.column("length").take(pa.array(order))
        whole = b"".join(ids.to_pylist())
        if len(whole) > 4 * capacity:
            raise RuntimeError("a sequence is longer than its capacity")
        return pa.table({"sequence_id": group.column("sequence_id").slice(0, 1), "ids": pa.array([whole], pa.binary()),
                         "lengths": pa.array([lens.to_pylist()], pa.list_(pa.int64()))})
    return run


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (little-endian unsigned 32-bit), ``lengths`` of its pieces
    in order.  Takes the rows of ``pack_documents`` with ids.  A group is one sequence, so it is bounded."""
    return (packed.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id")
            .applyInArrow(_row(capacity), "sequence_id long, ids binary, lengths array<long>"))
