"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Features are the presence of n-grams of words and of word shapes (case, digits, punctuation runs,
repetition of the word before), hashed to a fixed number of slots. Each slot is scaled by the log
ratio of its smoothed counts in the two classes, and a support vector machine is fitted on the scaled
indicators by dual coordinate descent. Margins become scores by a logistic curve fitted on margins of
folds that the model in question has not seen.

The model is fitted on the driver from a sample of labelled rows of a stated bound (at most TRAIN_ROWS, the
first by a hash of their ids, and of these as many as have TRAIN_BYTES of feature slots): only the slots are sent there,
PIECE_BYTES at a time. Scoring runs over every whole text in place.

Defined cases: null and empty texts get the score of an empty feature set; labels without a
document, or null, are ignored, equal labels of one document count once; repeated rows get equal scores;
one class or none in the labels gives the constant score of the class share (0.5 without labels); an
empty table gives an empty result; other columns are kept by `reject_low_quality` and ignored by
`score_quality`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Work, batch_texts, give_back, joined, mixed, prefix_hashes, runs, span_hashes, text_chunks, word_table

#: Bits of the feature hash, labelled rows that a fit uses at most, and bytes of their slots (four a slot) after which no further row is taken.
BITS, TRAIN_ROWS, TRAIN_BYTES = 18, 6000, 48 << 20
#: Bytes of slots that are sent to the driver at once.
PIECE_BYTES = 4 << 20
#: Smoothing of the counts, cost of a margin error, sweeps of the descent, and folds for the calibration.
ALPHA, COST, SWEEPS, FOLDS = 1.0, 0.5, 15, 3
_IN_WORD = word_table(" \t\n\x0b\x0c\r")
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 4 digit, 8 punctuation, 16 other than ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 16
_KIND[[b for b in range(33, 127) if not _KIND[b]]] = 8
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _slots(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of all texts, one after the other, and where each text's begin (the end as the last entry)."""
    data, texts = joined(raws)
    starts, ends = runs(_IN_WORD[data])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(raws) + 1, np.int64)
    words = span_hashes(prefix_hashes(_LOW[data]), starts, ends)
    kinds = _KIND[data]
    shape = np.bitwise_or.reduceat(kinds, starts).astype(np.uint64)  # blanks after a word have no kind
    head, tail = kinds[starts].astype(np.uint64), kinds[ends - 1].astype(np.uint64)
    last = data[ends - 1].astype(np.uint64) * (tail == 8)
    before = data[np.maximum(starts, ends - 2)].astype(np.uint64) * (kinds[np.maximum(starts, ends - 2)] == 8)
    length = np.minimum(np.log2(ends - starts).astype(np.uint64), np.uint64(7))
    look = mixed(((shape * np.uint64(32) + head) * np.uint64(32) + tail) * np.uint64(65536) + last * np.uint64(256) + before + (length << np.uint64(40)))
    owner = np.searchsorted(texts, starts, side="right") - 1
    with_next = np.flatnonzero(owner[:-1] == owner[1:])
    with_two = with_next[:-1][np.diff(with_next) == 1]
    same = words[with_next] == words[with_next + 1]
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    made = [
        (owner, _slots(words, 1)),
        (owner, _slots(look, 2)),
        (owner[with_next], _slots(words[with_next] * step + words[with_next + 1], 3)),
        (owner[with_next], _slots(look[with_next] * step + look[with_next + 1], 4)),
        (owner[with_two], _slots((look[with_two] * step + look[with_two + 1]) * step + look[with_two + 2], 5)),
    ]
    # One word twice, three and four times in a row, as n-grams of "the same".
    at = with_next[same]
    for salt in (6, 7, 8):
        made.append((owner[at], _slots(np.ones(len(at), np.uint64), salt)))
        at = at[np.isin(at + 1, with_next[same])]
    # Shapes at a text's two ends, as n-grams with the border.
    edge = np.flatnonzero(np.diff(owner, prepend=-1))
    made.append((owner[edge], _slots(look[edge], 9)))
    edge = np.flatnonzero(np.diff(owner, append=len(raws)))
    made.append((owner[edge], _slots(look[edge], 10)))
    both = np.unique(np.concatenate([(o << BITS) | s for o, s in made]))
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(raws) + 1))


@dataclass
class NBSVM:
    """Weights and ratios by slot, bias, and the logistic curve over margins."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    scale: float
    offset: float

    def scores(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        ratio = self.ratio[slots]
        n, owner = len(first) - 1, np.repeat(np.arange(len(first) - 1), np.diff(first))
        dots = np.bincount(owner, self.weights[slots] * ratio, n)  # by text, so that equal texts give equal sums
        length = np.maximum(1.0, np.sqrt(np.bincount(owner, ratio * ratio, n)))
        margin = dots / length + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.offset, -500, 500)))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """For each slot the log of its smoothed share among label 1 over that among label 0."""
    size = 1 << BITS
    p, q = np.full(size, alpha), np.full(size, alpha)
    for row, label in zip(rows, labels.tolist(), strict=True):
        (p if label else q)[row] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, sweeps: int = SWEEPS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights over scaled indicators and bias (an indicator that is always 1) that minimize the L2-regularized hinge loss."""
    w, bias = np.zeros(1 << BITS), 0.0
    # Scaled indicators take twice the memory of the slots: they are made anew for each step.
    norms = [max(1.0, float(np.linalg.norm(ratio[r]))) for r in rows]
    squares = [float(x @ x) + 1.0 for x in (ratio[r] / n for r, n in zip(rows, norms, strict=True))]
    dual, sign = np.zeros(len(rows)), np.where(labels > 0, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            row, y = rows[i], sign[i]
            x = ratio[row] / norms[i]
            gradient = y * (float(w[row] @ x) + bias) - 1.0
            new = min(max(dual[i] - gradient / squares[i], 0.0), cost)
            if (change := (new - dual[i]) * y) != 0.0:
                dual[i] = new
                w[row] += change * x
                bias += change
                moved = max(moved, abs(change))
        if moved < 1e-3 * cost:
            break
    return w, bias


def _margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.asarray([float(w[r] @ ratio[r]) / max(1.0, float(np.linalg.norm(ratio[r]))) + bias for r in rows])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> NBSVM:
    """A model from distinct slots and 0/1 labels."""
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        return NBSVM(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    fold = np.random.default_rng(5).permutation(len(rows)) % FOLDS
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        used = np.flatnonzero(fold != k).tolist()
        part, y = [rows[i] for i in used], labels[used]
        ratio = log_ratios(part, y)
        w, bias = dual_descent(part, y, ratio)
        out = np.flatnonzero(fold == k).tolist()
        margin[out] = _margins([rows[i] for i in out], ratio, w, bias)
    scale, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit, with a small ridge
        s = 1 / (1 + np.exp(-np.clip(scale * margin + offset, -30, 30)))
        d, h = s - labels, s * (1 - s) + 1e-9
        g = np.array([(d * margin).sum() + 1e-3 * scale, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        scale, offset = scale - float(step[0]), offset - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    ratio = log_ratios(rows, labels)
    w, bias = dual_descent(rows, labels, ratio)
    return NBSVM(w, ratio, bias, scale, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> NBSVM:
    """Fit on the first labelled rows, by a hash, whose documents are not held out: train_rows at most, and none after train_bytes of slots."""
    known = labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("_quality")).where(F.col("_quality").isin(0, 1) & F.col("_label_id").isNotNull() & ~held_out(F.col("_label_id")))
    # The sample is bounded by train_rows, whatever the number of labels.
    sample = F.broadcast(known.orderBy(F.xxhash64("_label_id"), "_label_id", "_quality").limit(train_rows))
    texts = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_label_id")).select("doc_id", "text", "_quality")

    def slots(batches):
        for batch in batches:
            ids, quality = batch.column(0), batch.column(2)
            for first, raws in text_chunks(batch_texts(batch)):
                s, at = features(raws)
                rows = [s[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(raws)), quality.slice(first, len(raws)), pa.array(rows, pa.binary())], names=["doc_id", "quality", "slots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # A document that is there more than once would bring more than its label: one row for each label and distinct feature set.
    work, order = Work(docs.sparkSession, "quality"), [F.xxhash64("doc_id"), "doc_id", "quality", "slots"]
    made = texts.mapInArrow(slots, f"doc_id {kind}, quality int, slots binary").distinct().orderBy(*order).limit(train_rows)
    # One task orders train_rows rows at most.
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    made = made.withColumns({"_at": F.count(F.lit(1)).over(w), "_before": F.sum(F.octet_length("slots")).over(w) - F.octet_length("slots")})
    made = work.write(made.where(F.col("_before") < train_bytes).select("_at", "_before", "quality", "slots"), "sample")
    rows, y = [], []
    for r in _pieces(made, min(made.agg(F.max("_before")).first()[0] or 0, train_bytes)):
        rows.append(np.frombuffer(r["slots"], "<i4"))
        y.append(r["quality"])
    work.drop("sample")
    model = fit(rows, np.asarray(y, float))
    del rows
    give_back()  # the sample was the driver's
    return model


def _pieces(made: DataFrame, last: int):
    """The sample's rows in their order, PIECE_BYTES of slots at a time: what is on its way to the driver is in its memory more than once."""
    for start in range(0, last + 1, PIECE_BYTES):
        piece = made.where((F.col("_before") >= start) & (F.col("_before") < start + PIECE_BYTES)).select("_at", "quality", "slots").collect()
        yield from sorted(piece, key=lambda r: r["_at"])
        del piece
        give_back()


def _scored(batches, shared):
    """Batches with their scores."""
    for batch in batches:
        texts, scores = batch_texts(batch), []
        for _, raws in text_chunks(texts):
            scores.append(shared.value.scores(*features(raws)))
        yield batch, np.concatenate(scores) if scores else np.zeros(0)


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, train_rows))  # 2 ** BITS weights and ratios

    def scan(batches):
        for batch, score in _scored(batches, shared):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_low_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.5, training_docs: DataFrame | None = None) -> DataFrame:
    """The documents that score at least threshold, with all their columns and in place.

    The labels' texts come from training_docs if given, else from docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs if training_docs is None else training_docs, labels, train_rows))

    def scan(batches):
        for batch, score in _scored(batches, shared):
            yield batch.filter(pa.array(score >= threshold, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
