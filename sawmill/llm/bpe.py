"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Texts become pre-tokens with positions, kept per frame of documents as positions in the frame's
   dictionary; a frame's distinct words are dealt by hash into parts.
2. A part sees every occurrence of its words in any dictionary and merges each distinct word once.
3. The ids go back to the frames that asked, where each document is put together by position.

Decoding looks ids up in the token-byte table.  That table and the merge ranks come from the
vocabulary file, have as many rows as the vocabulary, and are broadcast.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import bounded_batches, col, lean, parts_for, text_of, written
from sawmill.llm.frames import FRAME_CHARS, Frame, by_part, pack, pack_strings, unpack, unpack_strings
from sawmill.llm.words import texts

LONG = 64  # bytes from which on a word is merged with a heap
NONE = np.iinfo(np.int64).max
#: White space, then other characters: no pre-token reaches over the end of such a segment.
SEGMENT = r"\s*\S+|\s+"
SEGMENTS = 1 << 16  # segments whose pre-tokens a task keeps; it starts over when full


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f.read().splitlines())}


class Merges:
    """Merges of pairs of token ids, from the ranks of their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The same for single look-ups; made where a long word needs it."""
        return dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        out: list = [None] * len(words)
        open_ = []
        for i, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[i] = (rank,)
            elif len(w) > LONG:
                out[i] = self._long(w)
            else:
                open_.append(i)
        for s in range(0, len(open_), 200_000):
            at = open_[s:s + 200_000]
            for i, ids in zip(at, self._batch([words[i] for i in at]), strict=True):
                out[i] = ids
        counts = np.fromiter(map(len, out), np.uint32, len(out))
        ids = np.fromiter((x for ids in out for x in ids), np.uint32, int(counts.sum()))
        return ids, counts

    def _batch(self, words: list[bytes]) -> list[list[int]]:
        """All words at once: each round merges the first lowest pair of every word that has one."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lens)
        rank = np.full(len(sym), NONE)
        inner = word[:-1] == word[1:]
        rank[:-1][inner] = self.rank(sym[:-1][inner], sym[1:][inner])
        done: list = [None] * len(words)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            ended = least == NONE
            for k in np.flatnonzero(ended):
                done[word[starts[k]]] = sym[starts[k]:starts[k] + sizes[k]].tolist()
            first = np.where((rank == np.repeat(least, sizes)) & (rank != NONE), np.arange(len(sym)), len(sym))
            at = np.minimum.reduceat(first, starts)[~ended]
            sym[at] = rank[at]
            keep = np.repeat(~ended, sizes)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            if not len(sym):
                break
            for left in (at, at[(at > 0)] - 1):
                right = np.minimum(left + 1, len(sym) - 1)
                same = (right > left) & (word[right] == word[left])
                rank[left] = np.where(same, self.rank(sym[left], sym[right]), NONE)
        return done

    def _long(self, piece: bytes) -> list[int]:
        """One long word: lowest pairs first from a heap, neighbours as a linked list."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        right, left = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] is not None else len(ids)
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = rank, None
            right[i] = right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < len(ids) and (r := self.pairs.get(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x is not None]


def _part_of(words: list[bytes], n_parts: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(n_parts)).astype(np.int64)


def _frames(pattern: str, n_parts: int, limit: int):
    """id, text → frames: a row with each document's pre-tokens as places among the frame's words, keyed by the frame, and
    one row of words for each part that it asks, keyed by the part.

    A frame is named by a hash of its partition, its number there and its content, so frames of equal content
    are told apart.
    """
    def run(batches):
        split, cut = regex.compile(pattern), regex.compile(SEGMENT)

        place, closed = f"{TaskContext.get().partitionId()}/".encode(), 0

        def close(frame, known, id_type):
            nonlocal closed
            seq, by_rank = frame.ranked(len(known))
            names = list(known)
            words = [names[i].encode() for i in by_rank.tolist()]
            parts = _part_of(words, n_parts)
            order, ends = by_part(parts, n_parts)
            asks = [(p, pack_strings([words[i] for i in order[ends[p]:ends[p + 1]].tolist()]))
                    for p in range(n_parts) if ends[p] < ends[p + 1]]
            lens, packed = pack(np.array(frame.lens, np.uint32)), pack(seq)
            name = xxhash.xxh3_64(place + b"%d:" % closed + repr(frame.ids).encode() + lens + packed)
            closed += 1
            for _, blob in asks:
                name.update(blob)
            name, none = int(np.int64(np.uint64(name.intdigest()))), [None] * len(asks)
            return pa.record_batch([
                pa.array([name, *(p for p, _ in asks)], pa.int64()), pa.array([name] * (1 + len(asks)), pa.int64()),
                pa.array([None, *(p for p, _ in asks)], pa.int32()), pa.array([None, *(w for _, w in asks)], pa.binary()),
                pa.array([frame.ids, *none], pa.list_(id_type)), pa.array([lens, *none], pa.binary()),
                pa.array([packed, *none], pa.binary()), pa.array([pack(parts.astype(np.uint32)), *none], pa.binary())],
                names=["key", "frame", "part", "words", "ids", "lens", "seq", "parts"])

        frame, known, segments = Frame(), {}, {}
        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                tokens = []
                for s in cut.findall(text.decode()):
                    if (got := segments.get(s)) is None:
                        got = tuple([known.setdefault(w, len(known)) for w in split.findall(s)])
                        if len(segments) < SEGMENTS:
                            segments[s] = got
                    tokens += got
                frame.add(doc_id, tokens, len(text))
                if frame.bytes >= limit:
                    yield close(frame, known, id_type)
                    frame, known, segments = Frame(), {}, {}
        if frame.ids:
            yield close(frame, known, id_type)
    return run


def _encode(merges):
    """The asks of one part → its answers, each distinct word merged once; a frame's own row has none."""
    def run(group):
        group = group.filter(group.column("part").is_valid())
        asked = [unpack_strings(x) for x in group.column("words").to_pylist()]
        known: dict[bytes, int] = {}
        at = [[known.setdefault(w, len(known)) for w in words] for words in asked]
        ids, counts = merges.value.encode(list(known))
        starts = np.cumsum(counts, dtype=np.int64) - counts
        out = []
        for words in at:
            n = counts[words].astype(np.int64)
            take = np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((pack(n.astype(np.uint32)), pack(ids[take])))
        return pa.table({"frame": group.column("frame"), "part": group.column("part"),
                         "counts": pa.array([x[0] for x in out], pa.binary()), "answer": pa.array([x[1] for x in out], pa.binary())})
    return run


def _assemble(frames, answers):
    """A frame and its answers → one row per document; asks have no documents."""
    frames = frames.filter(frames.column("part").is_null())
    got = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "counts", "answer")), strict=True))
    by_part_counts = np.concatenate([unpack(x[1]) for x in got] or [np.empty(0, np.uint32)]).astype(np.int64)
    ids = np.concatenate([unpack(x[2]) for x in got] or [np.empty(0, np.uint32)])
    names, blobs = [], []
    for doc_ids, lens, seq, parts in zip(*(frames.column(c).to_pylist() for c in ("ids", "lens", "seq", "parts")), strict=True):
        order = np.argsort(unpack(parts), kind="stable")
        if len(order) != len(by_part_counts):
            raise RuntimeError("a frame lacks answers")
        counts, starts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        counts[order], starts[order] = by_part_counts, np.cumsum(by_part_counts) - by_part_counts
        seq, at = unpack(seq), 0
        for doc_id, n in zip(doc_ids, unpack(lens).tolist(), strict=True):
            words = seq[at:at + n]
            at += n
            size = counts[words]
            take = np.repeat(starts[words] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            names.append(doc_id)
            blobs.append(ids[take].astype("<u4").tobytes())
    return pa.table({"id": pa.array(names, frames.schema.field("ids").type.value_type), "ids": pa.array(blobs, pa.binary())})


def _in_order(rows: DataFrame) -> bool:
    """Whether a task of ``rows`` surely finds the same rows in the same order when it is run again: they come from files or a
    local table and nothing was shuffled, limited or cached on the way."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Exchange", "Limit", "TakeOrdered", "InMemoryTableScan", "ExistingRDD"))


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", *,
               frame_chars: int = FRAME_CHARS) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    Each match of ``pattern`` is merged on its own, without special tokens.  Null and empty texts have no
    tokens.  Repeated rows and equal ids are encoded each.  An empty table gives an empty result.  Other
    columns are not read.
    """
    spark = docs.sparkSession
    n_parts = parts_for(docs)
    bounded_batches(spark)
    base = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = base.schema["id"].dataType
    merges = spark.sparkContext.broadcast(Merges(ranks))
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("part", T.IntegerType()),
        T.StructField("words", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lens", T.BinaryType()),
        T.StructField("seq", T.BinaryType()), T.StructField("parts", T.BinaryType())])
    # a task that is run again must find the same frames: its rows must come in the same order
    base = base if _in_order(base) else written(base, "bpe-texts")
    # dealt once by key: the parts take their asks from that shuffle, and the frames that wait there meet their answers
    frames = base.mapInArrow(lean(_frames(pattern, n_parts, frame_chars)), schema)
    answers = frames.groupBy("key").applyInArrow(_encode(merges), "frame long, part int, counts binary, answer binary")
    out = (frames.groupBy("key").cogroup(answers.groupBy("frame"))
           .applyInArrow(_assemble, T.StructType([T.StructField("id", id_type), T.StructField("ids", T.BinaryType())])))
    return out.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids.  A null id list decodes to no bytes; an id that the
    vocabulary lacks is an error.  Narrow: no shuffle."""
    spark = encoded.sparkSession
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    table = spark.sparkContext.broadcast(tokens)

    def run(batches):
        look = table.value.__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = [b"".join(map(look, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(ids_col).to_pylist()]
                yield pa.record_batch([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(lean(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
