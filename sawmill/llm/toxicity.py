"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled first: a word, a beginning or an ending that
occurs in toxic labelled documents and hardly in others (a binomial test over the sample, strict
enough for the number of candidates) marks its tokens in toxic documents.  The field has hashed
features of a word (itself, beginnings, endings) and of its neighbours, and a transition per pair of
labels; it is fitted by gradient steps on all the labelled tokens, in windows.  Scoring runs
forward-backward over whole texts: chains of ``CHAIN`` words, many at once, that pass their messages on; a
logistic calibration turns the two highest marginals and the expected number of toxic words into the score.

The field is fitted in one task, on a bounded sample: the ``sample`` labelled rows that come first
by a seeded hash, of ``total_chars`` characters together at most; a text that no longer fits is left out,
the ones after it still come in.  Only the fitted field reaches the driver.  Everything else covers all rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sawmill.llm.common import bounded_batches, col, lean, text_of

SAMPLE = 6000
TOTAL_CHARS = 24_000_000
THRESHOLD = 0.3
SPAN = 0.5  # marginal from which on a word belongs to a span
CHAIN = 128
WINDOW = 32
STEPS = 200  # gradient steps at least, however small the sample
BATCH = 1024  # windows of a step at most
BITS = 18
WORD = re.compile(r"\w+")
WIDTH = 8  # features of a word at most
CACHE = 1 << 20
CLIP = 25.0
SEED = 11


def features(word: str) -> list[str]:
    """The word, its beginnings and its endings."""
    w = word.lower()
    return [f"={w}", *(f"^{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k), *(f"{w[-k:]}$" for k in (3, 4, 5) if len(w) >= k)]


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & ((1 << BITS) - 1)


def forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False, *,
                     last: np.ndarray | None = None, end: np.ndarray | float = 0.5):
    """Marginals of label 1 for chains (rows) of potentials ``e`` for it; with ``pairs`` also the expected transitions.

    ``start`` holds the message into a chain (one for all, or a row each), ``end`` the share of label 1 in the one that
    comes back into its last word; ``last`` says where that is, for chains shorter than the row.
    """
    rows, length = e.shape
    psi = np.exp(np.clip(e, -CLIP, CLIP))
    last = np.full(rows, length - 1) if last is None else last
    f = np.empty((length, rows))
    f1 = start[..., 1] * psi[:, 0]
    f[0] = f1 = f1 / (start[..., 0] + f1)
    for t in range(1, length):
        one = ((1 - f1) * trans[0, 1] + f1 * trans[1, 1]) * psi[:, t]
        f[t] = f1 = one / (one + (1 - f1) * trans[0, 0] + f1 * trans[1, 0])
    b = np.empty((length, rows))  # share of label 1 in the backward message
    b[-1] = end
    for t in range(length - 2, -1, -1):
        zero, one = 1 - b[t + 1], b[t + 1] * psi[:, t + 1]
        n0, n1 = trans[0, 0] * zero + trans[0, 1] * one, trans[1, 0] * zero + trans[1, 1] * one
        b[t] = np.where(t >= last, end, n1 / (n0 + n1))
    on = f * b
    marginal = (on / (on + (1 - f) * (1 - b))).T
    if not pairs:
        return marginal, None
    left = np.stack([1 - f[:-1], f[:-1]])
    right = np.stack([1 - b[1:], b[1:] * psi.T[1:]])
    xi = left[:, None] * trans[:, :, None, None] * right[None]
    return marginal, xi / xi.sum((0, 1))


@dataclass
class Field:
    """Weights: of a word's own features and of the words before and after it, and of transitions."""
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    trans: np.ndarray
    bias: float
    calibration: np.ndarray

    def potentials(self, word: str) -> tuple[float, float, float]:
        slots = [_slot(f) for f in features(word)]
        return float(self.own[slots].sum()) + self.bias, float(self.before[slots[0]]), float(self.after[slots[0]])


def marginals(field: Field, docs: list[list[int]], table: np.ndarray) -> list[np.ndarray]:
    """Marginals of each word of each document; ``table`` has the potentials of each word number."""
    lens = np.array([len(d) for d in docs])
    flat = np.concatenate([np.asarray(d, np.int64) for d in docs]) if lens.sum() else np.empty(0, np.int64)
    e = table[flat, 0].copy()
    ends = np.cumsum(lens)
    inner = np.ones(len(flat), bool)
    inner[(ends - lens)[lens > 0]] = False
    where = np.flatnonzero(inner)
    e[where] += table[flat[where - 1], 1]
    e[where - 1] += table[flat[where], 2]
    out = np.empty(len(flat))
    count = -(-lens // CHAIN)  # chains of each document
    first = np.cumsum(count) - count
    begin = np.repeat(ends - lens, count) + CHAIN * (np.arange(count.sum()) - np.repeat(first, count))
    stop = np.minimum(begin + CHAIN, np.repeat(ends, count))
    start, end = _messages(e, begin, stop, first, count, field.trans)
    for c in range(0, len(begin), 8192):
        some = slice(c, c + 8192)
        at = begin[some, None] + np.arange(CHAIN)
        real = at < stop[some, None]
        padded = np.where(real, e[np.minimum(at, len(e) - 1)], -CLIP)
        got, _ = forward_backward(padded, field.trans, start[some], last=real.sum(1) - 1, end=end[some])
        out[at[real]] = got[real]
    return np.split(out, ends[:-1])


def _messages(e: np.ndarray, begin: np.ndarray, stop: np.ndarray, first: np.ndarray, count: np.ndarray, trans: np.ndarray):
    """The message into each chain's first word, and the share of label 1 in the one back into its last word.

    A chain is the product of its words' matrices; messages cross it at once, chain by chain, for all documents together.
    """
    start, back = np.full((len(begin), 2), 0.5), np.full((len(begin), 2), 0.5)
    across = np.empty((len(begin), 2, 2))
    linked = np.flatnonzero(np.repeat(count > 1, count))
    linked = linked[np.argsort(begin[linked] - stop[linked], kind="stable")]  # long ones first: those that go on are a beginning
    words = (stop - begin)[linked]
    m = np.repeat(np.eye(2)[:, :, None], len(linked), 2)
    for t in range(words.max(initial=0)):
        k = int(np.searchsorted(-words, -t))
        zero, one = m[:, 0, :k], m[:, 1, :k]
        if t:
            zero, one = zero * trans[0, 0] + one * trans[1, 0], zero * trans[0, 1] + one * trans[1, 1]
        m[:, 1, :k] = one * np.exp(np.clip(e[begin[linked[:k]] + t], -CLIP, CLIP))
        m[:, 0, :k] = zero
        if t % 8 == 7:  # before numbers leave a double's range
            m[:, :, :k] /= m[:, :, :k].sum((0, 1))
    across[linked] = (m / m.sum((0, 1))).transpose(2, 0, 1)

    def scaled(m: np.ndarray) -> np.ndarray:
        return m / m.sum(1, keepdims=True)

    for k in range(1, count.max(initial=0)):
        here = first[count > k] + k
        start[here] = scaled(np.einsum("ni,nij->nj", start[here - 1], across[here - 1]) @ trans)
        here = (first + count)[count > k] - k
        back[here - 1] = scaled(np.einsum("nij,nj->ni", across[here], back[here]) @ trans.T)
    return start, back[:, 1]


def evidence(m: np.ndarray) -> tuple[float, float, float]:
    """Log odds of the two highest marginals and the expected number of words above one half."""
    top = np.sort(np.partition(m, -2)[-2:])[::-1] if len(m) > 1 else m
    top = np.clip(np.concatenate([top, np.zeros(2)])[:2], 1e-6, 1 - 1e-6)
    return (*np.log(top / (1 - top)), float(np.log1p(m[m > SPAN].sum())))


class Vocabulary:
    """Words of a sample as numbers, with the numbers of their features."""

    def __init__(self, texts: Iterable[str]):
        known: dict[str, int] = {}
        self.docs = [np.fromiter((known.setdefault(m.group(), len(known)) for m in WORD.finditer(t)), np.int32) for t in texts]
        self.words = list(known)
        names: dict[str, int] = {}
        self.features = np.full((len(known), WIDTH), -1, np.int32)  # -1: no such feature
        for i, w in enumerate(self.words):
            own = [names.setdefault(f, len(names)) for f in features(w)]
            self.features[i, :len(own)] = own
        self.slots = np.fromiter(map(_slot, names), np.int32, len(names))

    def features_of(self, doc: np.ndarray) -> np.ndarray:
        """The distinct features of a document's words."""
        found = np.unique(self.features[np.unique(doc)])
        return found[found >= 0]


def marked_features(words: Vocabulary, ys: np.ndarray) -> np.ndarray:
    """For each feature whether toxic documents have it beyond chance; found in turn for what is still unexplained."""
    n, toxic = len(words.slots), int(ys.sum())
    marked = np.zeros(n, bool)
    if not toxic or toxic == len(ys):
        return marked

    def count(sets):
        total = np.zeros(n, np.int64)
        for fs in sets:
            total[fs] += 1
        return total

    in_clean = count(words.features_of(d) for d, y in zip(words.docs, ys, strict=True) if not y)
    left = [words.features_of(d) for d, y in zip(words.docs, ys, strict=True) if y]
    rate = toxic / len(ys)
    while left:
        in_toxic = count(left)
        at = np.flatnonzero((in_toxic >= 3) & (in_clean <= 0.02 * in_toxic))
        a, b = in_toxic[at], in_clean[at]
        # chance that of a + b documents at least a are toxic, bounded by its largest term
        log_chance = a * np.log(rate) + b * np.log((a + b) * np.e / np.maximum(b, 1))
        found = np.zeros(n, bool)
        found[at] = log_chance < np.log(0.01 / max(np.count_nonzero(in_toxic), 1))
        if not (found & ~marked).any():
            break
        marked |= found
        left = [fs for fs in left if not found[fs].any()]
    return marked


def fit(sample: list[tuple[str, int]], *, epochs: int = 2, rate: float = 0.3, seed: int = SEED) -> Field:
    """A field and its calibration from labelled texts."""
    rng = np.random.default_rng(seed)
    vocabulary = Vocabulary(t for t, _ in sample)
    seqs, names = vocabulary.docs, vocabulary.words
    ys = np.array([y for _, y in sample])
    marked = np.append(marked_features(vocabulary, ys), False)
    hit = marked[vocabulary.features].any(1)
    size = 1 << BITS
    field = Field(np.zeros(size), np.zeros(size), np.zeros(size), np.ones((2, 2)) / 2, -6.0, np.array([-4.0, 0, 0, 0]))
    if not hit.any():
        return field

    windows = [(d, t) for d, s in enumerate(seqs) for t in range(0, len(s), WINDOW)]
    step = min(BATCH, max(256, len(windows) // 32))
    words = np.full((len(windows), WINDOW + 2), -1, np.int32)
    label = np.zeros((len(windows), WINDOW), bool)
    for i, (d, t) in enumerate(windows):
        part = seqs[d][max(0, t - 1):t + WINDOW + 1]
        off = 1 if t == 0 else 0
        words[i, off:off + len(part)] = part
        body = words[i, 1:-1]
        label[i] = (body >= 0) & hit[body] & bool(ys[d])
    slot = np.append(vocabulary.slots, size)[vocabulary.features]
    slot = np.append(slot, np.full((1, WIDTH), size, slot.dtype), 0)  # -1: no word
    own, before, after = (np.zeros(size + 1) for _ in range(3))
    grads = [np.full(size + 1, 1e-2) for _ in range(3)]
    log_trans, bias = np.zeros((2, 2)), -4.0
    start = np.array([0.5, 0.5])
    for _ in range(max(epochs, STEPS * step // len(windows))):
        order = rng.permutation(len(windows))
        for s in range(0, len(order), step):
            x, y = words[order[s:s + step]], label[order[s:s + step]]
            mid, real = x[:, 1:-1], x[:, 1:-1] >= 0
            first_b, first_a = slot[x[:, :-2], 0], slot[x[:, 2:], 0]
            e = np.where(real, own[slot[mid]].sum(2) + bias + before[first_b] + after[first_a], -CLIP)
            trans = np.exp(log_trans)
            m, xi = forward_backward(e, trans, start, pairs=True, last=real.sum(1) - 1)
            err = np.where(real, m - y, 0.0)
            for w, g, at, by in ((own, grads[0], slot[mid], np.repeat(err[:, :, None], WIDTH, 2)),
                                 (before, grads[1], first_b, err), (after, grads[2], first_a, err)):
                total = np.bincount(at.ravel(), by.ravel(), size + 1) + 1e-4 * w
                total[size] = 0
                g += total ** 2
                w -= rate * total / np.sqrt(g)
            bias -= rate * err.sum() / max(real.sum(), 1)
            both = (real[:, 1:] & real[:, :-1]).T
            seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & both.T).sum() for j in (0, 1)] for i in (0, 1)])
            log_trans -= rate * ((xi * both).sum((2, 3)) - seen) / max(both.sum(), 1)
    field = Field(own[:size], before[:size], after[:size], np.exp(log_trans), bias, field.calibration)
    table = np.array([field.potentials(w) for w in names]) if names else np.zeros((0, 3))
    x = np.array([(1.0, *evidence(m)) for s in range(0, len(seqs), 512) for m in marginals(field, seqs[s:s + 512], table)])
    w = np.array([-2.0, 0.2, 0.0, 0.0])
    for _ in range(30):  # ridge logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        w = w - np.linalg.solve(hess, x.T @ (p - ys) + 0.1 * w)
    field.calibration = w
    return field


def _score(shared):
    def run(batches):
        field, known, rows = shared.value, {}, []
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            scores, spans = [], []
            for s in range(0, len(texts), 512):
                some = texts[s:s + 512]
                if len(known) > CACHE:
                    known, rows = {}, []
                docs = []
                for t in some:
                    words = WORD.findall(t)
                    for w in words:
                        if w not in known:
                            known[w] = len(rows)
                            rows.append(field.potentials(w))
                    docs.append([known[w] for w in words])
                table = np.array(rows) if rows else np.zeros((0, 3))
                for t, m in zip(some, marginals(field, docs, table), strict=True):
                    z = field.calibration @ np.array((1.0, *evidence(m)))
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                    spans.append(_spans(t, m))
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, SPANS)], names=["id", "score", "spans"])
    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _spans(text: str, m: np.ndarray) -> list[dict]:
    """Runs of neighbouring words above one half, as code point offsets with their highest marginal."""
    if not len(m) or m.max() < SPAN:
        return []
    out, last = [], -2
    for i, word in enumerate(WORD.finditer(text)):
        if m[i] >= SPAN:
            if i == last + 1:
                out[-1] |= {"end": word.end(), "score": max(out[-1]["score"], float(m[i]))}
            else:
                out.append({"start": word.start(), "end": word.end(), "score": float(m[i])})
            last = i
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, *,
                sample: int = SAMPLE, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """``_id``, ``_hash``, ``_text``, ``_y`` of at most ``sample`` labelled texts of ``total_chars`` characters together, whole
    ones: the first by a seeded hash of the ids that ``train`` (of ``_id``) admits.  Equal texts of one id count once."""
    order = F.xxhash64(F.lit(SEED), F.col("_id"))
    picked = (labels.select(col(id_col).alias("_id"), col(label_col).alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
              .groupBy("_id").agg(F.max("_y").alias("_y")).where(train).orderBy(order, "_id").limit(sample))
    texts = docs.select(col(id_col).alias("_doc"), text_of(text_col).alias("_text"))
    # ``picked`` has at most ``sample`` rows
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).withColumn("_hash", F.xxhash64("_text"))
    keys = (rows.groupBy("_id", "_hash").agg(F.max(F.length("_text")).cast("long").alias("_chars"))
            .orderBy(order, "_id", "_hash").limit(sample).toArrow())
    total, fits = 0, []
    for chars in keys.column("_chars").to_pylist():
        fits.append(total + chars <= total_chars)
        total += chars * fits[-1]
    chosen = docs.sparkSession.createDataFrame(keys.select(["_id", "_hash"]).filter(pa.array(fits, pa.bool_())))
    return rows.join(F.broadcast(chosen), ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))


def _ordered(rows: Iterable[tuple]) -> list[tuple[str, int]]:
    return [(text, int(y)) for _, _, text, y in sorted(rows, key=lambda r: (r[0], r[1]))]


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, **limits) -> list[tuple[str, int]]:
    """The texts and labels of ``sample_rows``, in order of id and hash."""
    return _ordered(sample_rows(docs, labels, id_col, text_col, label_col, train, **limits).select("_id", "_hash", "_text", "_y").collect())


def _fitted(sample: DataFrame) -> Field:
    """``fit`` of ``sample_rows`` in one task: the sample is bounded, but what a fit takes of memory would come on top of all
    that the driver holds."""
    def run(batches):
        field = fit(_ordered(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        yield pa.record_batch([pa.array([pickle.dumps(field)], pa.binary())], names=["field"])

    got = sample.select("_id", "_hash", "_text", "_y").coalesce(1).mapInArrow(lean(run), "field binary").collect()
    return pickle.loads(got[0]["field"]) if got else fit([])


def toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", *, threshold: float = THRESHOLD, sample: int = SAMPLE,
             total_chars: int = TOTAL_CHARS, name: Column | None = None) -> DataFrame:
    """One row per input row: ``id_col`` (or ``name`` in its place), ``score``, ``predicted``, ``spans``.

    ``train`` is a condition on the column ``_id``, the ids labels may be learned from.  ``spans`` holds start, end
    (code points) and score of the toxic spans.  Only texts are scored; ids and labels pick the sample.

    Null and empty texts have no words: their score is the calibration's lowest.  Labels that are null or
    neither 0 nor 1 and rows with a null id are not learned from; contradicting labels of an id count as
    toxic.  Without a toxic or a clean row to learn from every score is the same, low one.  Repeated rows are scored
    each.  An empty table gives an empty result.  Other columns are not read.  Narrow but for the sample.
    """
    bounded_batches(docs.sparkSession)
    field = _fitted(sample_rows(docs, labels, id_col, text_col, label_col, train, sample=sample, total_chars=total_chars))
    base = docs.select((col(id_col) if name is None else name).alias("id"), text_of(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.DataType.fromDDL("array<struct<start:int,end:int,score:double>>"))])
    shared = docs.sparkSession.sparkContext.broadcast(field)  # 2 ** BITS weights per table: a fixed size
    return base.mapInArrow(lean(_score(shared)), schema).select(
        F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
