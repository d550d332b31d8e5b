"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is a node with two states, good and bad.  A line's own shape and that of the lines before and after
it decide its potential; one table of potentials joins neighbours.  Forward-backward gives each line's marginal, and their
average weighted by length is the document's raw quality, which a logistic curve turns into the score.

The model is fitted in numpy on labelled documents, at most `SAMPLE` of each label, chosen by a hash of their ids; a
document's label stands for all its lines.  Labels of held-out ids are never read.  Every text is scored whole.

Null and empty texts have no line and score 0.  Documents without a label only lack a part in the fit; without any usable
label the score is that of an even model.  Rows with equal ids are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks, coded, words_of
from logclinic.llm.staging import prepare
from logclinic.llm.tokens import per_text

#: Labelled documents of each label that the fit may use.
SAMPLE = 1500
HELD_OUT = 2
THRESHOLD = 0.7
STEPS = 120

#: Upper edges of the bins of shares, and of word lengths and line lengths.
SHARES = np.array([1e-9, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
LENGTHS = np.array([2, 3, 4, 5, 6, 7, 9, 12])
LINE_WORDS = np.array([1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5, 128.5])
BINS = 10  # nine values and one for a line that is not there
N_FEATURES = 9

_CLASS = np.zeros(256, np.uint8)
for _class, _letters in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>~^=+_\\", b"|", b"!?", b"0123456789", b".,;:"), 1):
    _CLASS[np.frombuffer(_letters, np.uint8)] = _class


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the features of all lines with a word, the lines' bytes, and the number of such lines per text."""
    parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pa.concat_arrays([parts.flatten()])
    words, counts = words_of(lines)
    codes, _ = coded(words)
    lengths = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(lines.buffers()[2], np.uint8)[: int(lengths.sum())] if lines.buffers()[2] else np.zeros(0, np.uint8)
    classes = _CLASS[raw]
    full = counts > 0
    bytes_of = np.maximum(lengths, 1)
    shares = [per_text((classes == k).astype(np.int32), lengths) / bytes_of for k in range(1, 7)]
    again = np.concatenate([[False], codes[1:] == codes[:-1]])[: len(codes)]
    again[(np.cumsum(counts) - counts)[full]] = False
    shares.append(per_text(again.astype(np.int32), counts) / np.maximum(counts, 1))
    in_words = per_text(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64), counts)
    bins = [np.searchsorted(SHARES, s) for s in shares]
    bins += [np.searchsorted(LENGTHS, in_words / np.maximum(counts, 1)), np.searchsorted(LINE_WORDS, counts)]
    return np.stack(bins, axis=1).astype(np.uint8)[full], lengths[full], per_text(full.astype(np.int64), n_parts)


def with_neighbours(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slots in the weight table of each line: its own features, those of the line before and of the line after."""
    heads = np.cumsum(counts) - counts
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    before[heads[counts > 0]] = BINS - 1
    after[(heads + counts - 1)[counts > 0]] = BINS - 1
    slots = np.concatenate([bins, before, after], axis=1).astype(np.int64)
    return slots + np.arange(3 * N_FEATURES) * BINS


def forward_backward(good: np.ndarray, counts: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the state good, and expected numbers of neighbouring states per text (texts, 2, 2).

    `good`: each line's potential of being good, its share of the two; `joint`: potentials of (state, next state).
    All texts advance together, line by line; longer texts stay in the run.
    """
    order = np.argsort(-counts, kind="stable")
    heads = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    n_steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(n_steps), "left")
    forward, backward = good.copy(), np.full(len(good), 0.5)
    for t in range(1, n_steps):
        now = heads[: active[t]] + t
        a = forward[now - 1]
        to_good = good[now] * (a * joint[1, 1] + (1 - a) * joint[0, 1])
        to_bad = (1 - good[now]) * (a * joint[1, 0] + (1 - a) * joint[0, 0])
        forward[now] = to_good / (to_good + to_bad)
    pairs = np.zeros((len(counts), 2, 2))
    for t in range(n_steps - 2, -1, -1):
        now = heads[: active[t + 1]] + t
        b, g, a = backward[now + 1], good[now + 1], forward[now]
        of_good, of_bad = b * g, (1 - b) * (1 - g)
        from_good, from_bad = joint[1, 1] * of_good + joint[1, 0] * of_bad, joint[0, 1] * of_good + joint[0, 0] * of_bad
        cell = np.stack([(1 - a) * joint[0, 0] * of_bad, (1 - a) * joint[0, 1] * of_good, a * joint[1, 0] * of_bad, a * joint[1, 1] * of_good], axis=1)
        pairs[order[: active[t + 1]]] += (cell / cell.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
        backward[now] = from_good / (from_good + from_bad)
    marginal = forward * backward
    return marginal / (marginal + (1 - forward) * (1 - backward)), pairs


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights of the line features, potentials of neighbours, and the curve from raw quality to score."""

    def __init__(self):
        self.weights = np.zeros(3 * N_FEATURES * BINS)
        self.joint = np.zeros((2, 2))
        self.slope, self.offset = 1.0, 0.0

    def marginals(self, bins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots = with_neighbours(bins, counts)
        good = np.clip(sigmoid(self.weights[slots].sum(axis=1)), 1e-9, 1 - 1e-9)
        return *forward_backward(good, counts, np.exp(self.joint)), slots

    def raw(self, bins: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Average marginal of each text weighted by line length; 0 without lines."""
        marginal, _, _ = self.marginals(bins, counts)
        return per_text(marginal * lengths, counts) / np.maximum(per_text(lengths, counts), 1)

    def scores(self, bins: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = np.clip(self.raw(bins, lengths, counts), 1e-4, 1 - 1e-4)
        return np.where(counts > 0, sigmoid(self.slope * np.log(raw / (1 - raw)) + self.offset), 0.0)

    def fit(self, bins: np.ndarray, lengths: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model:
        """Maximum likelihood by Adam, texts weighted alike; then the curve."""
        seen = counts > 0
        labels_of = np.repeat(labels, counts)
        weight = np.repeat(1 / np.maximum(counts, 1), counts)
        share = np.bincount(labels[seen], minlength=2)
        balance = 0.5 / np.maximum(share, 1)
        observed = np.zeros((2, 2))
        per_doc = np.maximum(counts - 1, 0) / np.maximum(counts, 1) * balance[labels] * seen
        for label in (0, 1):
            observed[label, label] = per_doc[labels == label].sum()
        moments = [np.zeros_like(self.weights), np.zeros_like(self.weights), np.zeros((2, 2)), np.zeros((2, 2))]
        for step in range(1, STEPS + 1):
            marginal, pairs, slots = self.marginals(bins, counts)
            error = (labels_of - marginal) * weight * balance[labels_of]
            slope = np.bincount(slots.ravel(), weights=np.repeat(error, slots.shape[1]), minlength=len(self.weights)) - 1e-4 * self.weights
            expected = (pairs * (balance[labels] * seen / np.maximum(counts, 1))[:, None, None]).sum(axis=0)
            for k, (own, gradient) in enumerate(((self.weights, slope), (self.joint, observed - expected - 1e-2 * self.joint))):
                m, v = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient**2 - v)
                own += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        raw = np.clip(self.raw(bins, lengths, counts), 1e-4, 1 - 1e-4)[seen]
        self._fit_curve(np.log(raw / (1 - raw)), labels[seen])
        return self

    def _fit_curve(self, x: np.ndarray, labels: np.ndarray) -> None:
        """The cut between the labels comes to lie at the threshold; a fixed slope keeps scores away from 0 and 1."""
        order = np.argsort(x)
        sure, y = x[order], labels[order]
        wrong = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum()) + (y == 0).sum() / max(1, (y == 0).sum()) - np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
        best = np.flatnonzero(wrong == wrong.min())
        edges = np.concatenate([[sure[0] - 1], sure, [sure[-1] + 1]])
        cut = np.mean([(edges[k] + edges[k + 1]) / 2 for k in best])
        self.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - self.slope * cut)


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _features(batches):
    for block in blocks(batches):
        bins, lengths, counts = line_features(block.column("text"))
        ends = np.cumsum(counts)
        yield pa.RecordBatch.from_arrays(
            [
                block.column("label"),
                pa.array([bins[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)], pa.binary()),
                pa.array([lengths[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)], pa.binary()),
            ],
            ["label", "bins", "lengths"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """The model fitted on at most `sample` documents of each label outside the held-out ids."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (bucket(F.col(doc_id)) != HELD_OUT)).select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    chosen = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]).dropDuplicates(["id"]))  # at most twice the sample
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id").select("label", "text")
    found = rows.mapInArrow(_features, "label int, bins binary, lengths binary").collect()
    model = Model()
    if {row["label"] for row in found} != {0, 1}:
        return model
    lengths = [np.frombuffer(row["lengths"], np.int64) for row in found]
    bins = np.concatenate([np.frombuffer(row["bins"], np.uint8) for row in found]).reshape(-1, N_FEATURES)
    counts = np.array([len(x) for x in lengths])
    return model.fit(bins, np.concatenate(lengths), counts, np.array([row["label"] for row in found]))


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    prepare(docs.sparkSession)

    def score(batches):
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.scores(*line_features(block.column("text"))))], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(bucket(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
