"""Language-model scores by deleted interpolation of n-gram estimates (unigram and bigram).

``p(w | h) = l0 / (V + 1) + l1 * c(w) / N + l2 * c(h, w) / c(h)``; the weights l0, l1, l2 depend on the bucket
of the context's count (powers of two) and are learned by expectation-maximisation on held-out
counts: events of the rows kept for that (``dev``) under estimates from the rest (``main``).  Scores use the
counts of all training rows (``main`` and ``dev``).

Every training token of the corpus is counted.  Tokens live in frames of documents; a frame asks for each
of its distinct words and bigrams once and sends its own counts along, dealt by hash into parts, so the
lookup and the count are one shuffle of packed numbers.  Rows kept for EM have frames of their own.
The held-out events reach the driver as a histogram over (bucket, quantised estimates) whose number of
cells is bounded by the quantisation, not by the corpus.  Bigrams are told apart by a 48-bit hash besides
their part, words by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import bounded_batches, col, lean, parts_for, text_of, written
from sawmill.llm.frames import by_part, pack, unpack
from sawmill.llm.words import mix, texts, word_hashes

END = 0x656E64  # stands for a text's end among the words' hashes
FRAME_CHARS = 9_000_000  # bytes of text a frame holds; a document is never split
STEPS = 8  # quantisation steps per octave
ROUNDS = 60
ZERO = -10_000  # quantised estimate of an unseen event
_PAIR = np.uint64(0x9E3779B97F4A7C15)
ASKS = "array<struct<part:int,low:binary,high:binary,counts:binary>>"


def _parts(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)


def _split(keys: np.ndarray, counts: np.ndarray, n_parts: int, high_type):
    """Keys dealt into parts: the order that does it and one packed row per part."""
    order, ends = by_part(_parts(keys, n_parts), n_parts)
    low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(high_type)
    rows = []
    for p in range(n_parts):
        at = order[ends[p]:ends[p + 1]]
        if len(at):
            rows.append((p, low[at].tobytes(), high[at].tobytes(), pack(counts[at].astype(np.uint32))))
    return order, rows


def _frames(n_parts: int, limit: int):
    """id, text, role → frames of documents of one kind, with the words they ask for."""
    def run(batches):
        task, number = TaskContext.get().partitionId(), 0

        def close(frame, dev, id_type):
            ids, lens, test, seq = frame
            lens = np.array(lens, np.uint32)
            keys, at = np.unique(np.concatenate(seq), return_inverse=True)
            counted = np.repeat(~np.array(test, bool), lens)
            counts = np.bincount(at[counted], minlength=len(keys))
            order, asks = _split(keys, counts, n_parts, np.uint32)
            place = np.empty(len(keys), np.uint32)
            place[order] = np.arange(len(keys), dtype=np.uint32)
            ask_type = pa.list_(pa.struct([("part", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())]))
            return pa.record_batch([
                pa.array([(task << 32) + number], pa.int64()), pa.array([dev], pa.bool_()), pa.array([ids], pa.list_(id_type)),
                pa.array([test], pa.list_(pa.bool_())), pa.array([pack(lens)], pa.binary()), pa.array([pack(place[at])], pa.binary()),
                pa.array([keys[order].tobytes()], pa.binary()),
                pa.array([[dict(zip(("part", "low", "high", "counts"), a, strict=True)) for a in asks]], ask_type)],
                names=["frame", "dev", "ids", "test", "lens", "seq", "keys", "asks"])

        open_ = {False: ([], [], [], []), True: ([], [], [], [])}
        size, end = {False: 0, True: 0}, np.array([END], np.uint64)
        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            all_ = texts(b.column(1))
            for doc_id, text, words, role in zip(b.column(0).to_pylist(), all_, word_hashes(all_), b.column(2).to_pylist(), strict=True):
                dev = role == "dev"
                words = np.concatenate([words, end])
                for got, x in zip(open_[dev], (doc_id, len(words), role == "test", words), strict=True):
                    got.append(x)
                size[dev] += len(text) + 1
                if size[dev] >= limit:
                    yield close(open_[dev], dev, id_type)
                    open_[dev], size[dev], number = ([], [], [], []), 0, number + 1
        for dev in (False, True):
            if open_[dev][0]:
                yield close(open_[dev], dev, id_type)
                number += 1
    return run


def _merge(high_type):
    """The asks of one part → for each frame the counts in all training rows and in ``main`` alone."""
    def run(group):
        asks = list(zip(*(group.column(c).to_pylist() for c in ("frame", "dev", "low", "high", "counts")), strict=True))
        keys = [np.frombuffer(a[2], np.uint32) | (np.frombuffer(a[3], high_type).astype(np.uint64) << np.uint64(32)) for a in asks]
        sizes = np.array([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpack(a[4]) for a in asks])
        held = np.repeat(np.array([a[1] for a in asks], bool), sizes)
        every = np.bincount(at, counts, len(distinct)).astype(np.int64)
        main = np.bincount(at, np.where(held, 0, counts), len(distinct)).astype(np.int64)
        ends = np.cumsum(sizes)
        totals = [(int((every > 0).sum()), int(every.sum()), int((main > 0).sum()), int(main.sum()))] + [(0, 0, 0, 0)] * (len(asks) - 1)
        part = group.column("part")[0].as_py()
        return pa.table({
            "frame": pa.array([a[0] for a in asks], pa.int64()), "dev": pa.array([a[1] for a in asks], pa.bool_()),
            "part": pa.array([part] * len(asks), pa.int32()),
            "every": pa.array([pack(every[at[e - n:e]]) for e, n in zip(ends, sizes, strict=True)], pa.binary()),
            "main": pa.array([pack(main[at[e - n:e]]) if a[1] else None for a, e, n in zip(asks, ends, sizes, strict=True)], pa.binary()),
            **{k: pa.array([t[i] for t in totals], pa.int64()) for i, k in enumerate(("v", "n", "v_main", "n_main"))}})
    return run


MERGED = "frame long, dev boolean, part int, every binary, main binary, v long, n long, v_main long, n_main long"


def _bigrams(seq: np.ndarray, keys: np.ndarray):
    """Distinct (previous word, word) of a frame as hashes, and each token's place among them."""
    end = int(np.flatnonzero(keys == np.uint64(END))[0])
    before = np.concatenate([[end], seq[:-1]]).astype(np.uint64)
    pairs, at = np.unique((before << np.uint64(32)) | seq, return_inverse=True)
    h, w = keys[(pairs >> np.uint64(32)).astype(np.int64)], keys[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return mix(h * _PAIR + w), at, before.astype(np.int64)


def _read(row):
    seq, keys = unpack(row["seq"]), np.frombuffer(row["keys"], np.uint64)
    return seq, keys, unpack(row["lens"]).astype(np.int64)


def _bigram_asks(n_parts: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                seq, keys, lens = _read(row)
                pairs, at, _ = _bigrams(seq, keys)
                counted = np.repeat(~np.array(row["test"], bool), lens)
                _, asks = _split(pairs, np.bincount(at[counted], minlength=len(pairs)), n_parts, np.uint16)
                yield pa.record_batch([pa.array([row["frame"]] * len(asks), pa.int64()), pa.array([row["dev"]] * len(asks), pa.bool_())] + [
                    pa.array([a[i] for a in asks], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["frame", "dev", "part", "low", "high", "counts"])
    return run


def _answers(answers, column: str, kind: str) -> np.ndarray:
    got = sorted((p, x) for p, k, x in zip(*(answers.column(c).to_pylist() for c in ("part", "kind", column)), strict=True) if k == kind)
    return np.concatenate([unpack(x) for _, x in got]).astype(np.int64)


def _told(row, answers, column: str, n_parts: int):
    """Of each token of a frame: its count, its context's and its bigram's."""
    seq, keys, lens = _read(row)
    word = _answers(answers, column, "word")
    pairs, at, before = _bigrams(seq, keys)
    order, _ = by_part(_parts(pairs, n_parts), n_parts)
    pair = np.empty(len(pairs), np.int64)
    pair[order] = _answers(answers, column, "pair")
    return lens, word[seq], word[before], pair[at]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two of its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def _events(v: int, n: int, n_parts: int):
    """A held-out frame → its events by bucket and quantised estimates, relative to the uniform one."""
    def quantised(p):
        with np.errstate(divide="ignore"):
            return np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) * (v + 1))), ZERO).astype(np.int64)

    def run(frames, answers):
        out: dict[tuple, int] = {}
        for row in frames.to_pylist():
            _, word, context, pair = _told(row, answers, "main", n_parts)
            cells = np.stack([bucket_of(context), quantised(word / max(n, 1)), quantised(pair / np.maximum(context, 1))], 1)
            for cell, k in zip(*np.unique(cells, axis=0, return_counts=True), strict=True):
                out[tuple(cell.tolist())] = out.get(tuple(cell.tolist()), 0) + int(k)
        return pa.table({c: pa.array([k[i] for k in out], pa.int64()) for i, c in enumerate(("bucket", "one", "two"))}
                        | {"events": pa.array(list(out.values()), pa.int64())})
    return run


def learn_weights(cells: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by bucket from rows (bucket, quantised unigram, quantised bigram, events).

    EM with one pseudo-event for each estimate, so that no weight becomes 0 (but the bigram's in the
    bucket of unseen contexts); a bucket without events has equal weights.
    """
    buckets = 66
    weights = np.full((buckets, 3), 1 / 3)
    weights[0] = (0.5, 0.5, 0.0)
    if not len(cells):
        return weights
    at, events = cells[:, 0].astype(int), cells[:, 3].astype(float)
    ratio = np.stack([np.ones(len(cells)), *(np.where(cells[:, i] == ZERO, 0.0, 2.0 ** (cells[:, i] / STEPS)) for i in (1, 2))], 1)
    for _ in range(rounds):
        share = weights[at] * ratio
        share *= (events / share.sum(1))[:, None]
        got = np.stack([np.bincount(at, share[:, i], buckets) for i in range(3)], 1) + 1.0
        got[0, 2] = 0.0
        weights = got / got.sum(1, keepdims=True)
    return weights


def _scores(v: int, n: int, weights, n_parts: int):
    def run(frames, answers):
        ids, held, tokens, known, base, score = [], [], [], [], [], []
        for row in frames.to_pylist():
            lens, word, context, pair = _told(row, answers, "every", n_parts)
            w = weights[bucket_of(context)]
            p = w[:, 0] / (v + 1) + w[:, 1] * (word / max(n, 1)) + w[:, 2] * (pair / np.maximum(context, 1))
            starts = np.cumsum(lens) - lens
            ids += row["ids"]
            held += row["test"]
            tokens += lens.tolist()
            known += np.add.reduceat((word > 0).astype(np.int64), starts).tolist()
            base += np.add.reduceat(np.log10((word + 1) / (n + v + 1)), starts).tolist()
            score += np.add.reduceat(np.log10(p), starts).tolist()
        return pa.table({"id": pa.array(ids, frames.schema.field("ids").type.value_type), "held_out": pa.array(held, pa.bool_()),
                         "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})
    return run


def interpolated_scores(docs: DataFrame, role: Column, id_col: str = "doc_id", text_col: str = "text", *,
                        frame_chars: int = FRAME_CHARS) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``.

    ``role`` is "main" or "dev" for training rows and "test" for rows that nothing is learned from
    (``held_out``).  A text's tokens are its lower-cased (A-Z) words and one end.  ``n_known`` counts tokens
    that training rows have, ``base_score`` is the add-one unigram log10 probability, ``score`` the model's.

    Null and empty texts are one end token.  Repeated rows and equal ids count and are scored each.
    Without training rows every estimate is uniform; without "dev" rows the weights are equal.  An empty
    table gives an empty result.  Other columns are not read.  Frames and counts are written to the
    shared folder.
    """
    spark = docs.sparkSession
    n_parts = parts_for(docs)
    bounded_batches(spark)
    base = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"), role.alias("role"))
    id_type = base.schema["id"].dataType
    schema = (T.StructType().add("frame", "long").add("dev", "boolean").add("ids", T.ArrayType(id_type))
              .add("test", T.ArrayType(T.BooleanType())).add("lens", "binary").add("seq", "binary").add("keys", "binary")
              .add("asks", T.DataType.fromDDL(ASKS)))
    frames = written(base.mapInArrow(lean(_frames(n_parts, frame_chars)), schema), "lm-frames")
    words = written(frames.select("frame", "dev", F.explode("asks").alias("a")).select("frame", "dev", "a.*")
                    .groupBy("part").applyInArrow(_merge(np.uint32), MERGED), "lm-words")
    body = frames.drop("asks")
    pairs = written(body.mapInArrow(lean(_bigram_asks(n_parts)), "frame long, dev boolean, part int, low binary, high binary, counts binary")
                    .groupBy("part").applyInArrow(_merge(np.uint16), MERGED), "lm-pairs")
    v, n, v_main, n_main = (x or 0 for x in words.agg(*(F.sum(c) for c in ("v", "n", "v_main", "n_main"))).first())

    both = words.withColumn("kind", F.lit("word")).unionByName(pairs.withColumn("kind", F.lit("pair")))
    held = both.where("dev").select("frame", "part", "kind", "main")
    events = (body.where("dev").groupBy("frame").cogroup(held.groupBy("frame"))
              .applyInArrow(_events(v_main, n_main, n_parts), "bucket long, one long, two long, events long")
              .groupBy("bucket", "one", "two").agg(F.sum("events").alias("events"))
              .orderBy("bucket", "one", "two"))  # sums of doubles in a fixed order: reruns agree
    cells = events.toArrow()
    weights = learn_weights(np.stack([cells.column(c).to_numpy() for c in ("bucket", "one", "two", "events")], 1))

    answers = both.select("frame", "part", "kind", "every")
    id_out = (T.StructType().add("id", id_type).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long")
              .add("base_score", "double").add("score", "double"))
    scored = (body.groupBy("frame").cogroup(answers.groupBy("frame"))
              .applyInArrow(_scores(v, n, weights, n_parts), id_out))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                         F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
