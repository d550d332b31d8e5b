"""Language-model scores by masked pseudo-likelihood.

A small network in numpy predicts every word from the two words on either side: one embedding table per relative place,
a hidden layer, and a softmax in two steps, first over groups of words of similar frequency, then inside the group.  A
document's score is the sum of the log probabilities of all its words, each given its neighbours.

Word counts cover the whole corpus and are grouped by Spark; the most frequent words form the vocabulary, all others share
one entry of the network.  Such a word's probability is that of the entry times its own among all words outside the
vocabulary, from its count in the corpus and its spelling, so the neighbours tell that a rare word comes, not which.  Texts are dealt by their hash over training tasks whose number follows from the words of the corpus.  In each
round every task trains on its texts from the last average, and the tasks' parameters are averaged, weighted by words, in
slices that are spread over tasks.  Training starts from the corpus's own word frequencies and divides every parameter's
steps by the size of its gradients so far, so that one pass over all texts is enough; more are a parameter.  Only the
vocabulary and the averaged state, both of fixed size, pass through the driver.

Null and empty texts have no word; their sum is 0 and their mean null.  Rows with equal ids are scored one by one, equal
texts score alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logclinic.llm.blocks import blocks, coded, ranges, words_of
from logclinic.llm.packs import packed, unpacked
from logclinic.llm.staging import prepare, staged
from logclinic.llm.tokens import per_text

GROUPS = 32
GROUP_WORDS = 32
VOCABULARY = GROUPS * GROUP_WORDS
SIDE = 2
WIDTH = 16
#: Size of a step; every parameter divides it by the root of the squares of its gradients so far, which start here.
RATE = 0.2
FIRST_SQUARE = 1e-6
#: Words of a batch, and the batches of a block that make them fewer, down to a least number of words.
BATCH, BLOCK_BATCHES, LEAST_BATCH = 8192, 64, 256
SLICES = 16

#: Words of a training task in a pass: at least so many, and so many times the root of all words, so that a larger corpus
#: means more tasks and more steps in each.
TASK_WORDS = 1 << 21
TASK_WORDS_GROWTH = 64
#: Rounds of a pass, after each of which the tasks are averaged; a round has at least so many words per task.
ROUNDS = 4
ROUND_WORDS = 1 << 16
#: The greatest number of passes over all texts.  The first starts from the words' frequencies and learns nearly all.
PASSES = 1
#: With more passes, one text of so many is held out, to see when training ends: when a pass gains less than this per word.
HELD_OUT = 64
LEAST_GAIN = 0.01
ENTRY_BYTES = 2 << 20
#: Bytes of text in a block of scored texts.
SCORED_BYTES = 4 << 20
#: Bytes, and the border of a word.
SYMBOLS, END = 257, 256

UNKNOWN, EDGE = 0, 1  # entries before the words themselves


class Network:
    """Parameters as one flat vector with named views, and the squares of their gradients (of `near`, one per row)."""

    SHAPES = {"near": (2 * SIDE, VOCABULARY, WIDTH), "hidden": (WIDTH, WIDTH), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,), "word": (GROUPS, WIDTH, GROUP_WORDS), "word_bias": (GROUPS, GROUP_WORDS)}
    SQUARES = SHAPES | {"near": (2 * SIDE, VOCABULARY)}

    def __init__(self, flat: np.ndarray | None = None, squares: np.ndarray | None = None):
        size = lambda shapes: sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.random.default_rng(7).normal(0, 0.1, size(self.SHAPES)).astype(np.float32) if flat is None else flat
        self.squares = np.full(size(self.SQUARES), FIRST_SQUARE, np.float32) if squares is None else squares
        self.square: dict[str, np.ndarray] = {}
        for shapes, vector, put in ((self.SHAPES, self.flat, self.__setattr__), (self.SQUARES, self.squares, self.square.__setitem__)):
            at = 0
            for name, shape in shapes.items():
                put(name, vector[at : at + int(np.prod(shape))].reshape(shape))
                at += int(np.prod(shape))

    def start_from(self, counts: np.ndarray) -> None:
        """Biases as the logarithms of the entries' frequencies, so that training has only the neighbours to learn."""
        own = np.log(np.maximum(counts, 0.5)).reshape(GROUPS, GROUP_WORDS)
        of_group = log_sum(own)
        self.word_bias[:] = own - of_group[:, None]
        self.group_bias[:] = of_group - log_sum(of_group[None])

    def hidden_of(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = self.near[0, around[:, 0]]
        for j in range(1, 2 * SIDE):
            total = total + self.near[j, around[:, j]]
        return total, np.tanh(total @ self.hidden)

    def log_probabilities(self, around: np.ndarray, targets: np.ndarray) -> np.ndarray:
        _, h = self.hidden_of(around)
        groups, inner = targets // GROUP_WORDS, targets % GROUP_WORDS
        rows = np.arange(len(targets))
        scores = h @ self.group + self.group_bias
        found = scores[rows, groups] - log_sum(scores)
        order = np.argsort(groups.astype(np.uint8), kind="stable")
        borders = np.searchsorted(groups[order], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            own = order[borders[g] : borders[g + 1]]
            if len(own):
                scores = h[own] @ self.word[g] + self.word_bias[g]
                found[own] += scores[np.arange(len(own)), inner[own]] - log_sum(scores)
        return found

    def _move(self, name: str, gradient: np.ndarray, rate: np.float32, at: int | slice = slice(None)) -> None:
        squares = self.square[name]
        squares[at] += gradient * gradient
        getattr(self, name)[at] += rate * gradient / np.sqrt(squares[at])

    def train(self, around: np.ndarray, targets: np.ndarray, rate: float) -> None:
        """One step of gradient ascent over a batch."""
        rate, share = np.float32(rate), np.float32(1 / len(targets))
        total, h = self.hidden_of(around)
        groups = targets // GROUP_WORDS
        order = np.argsort(groups.astype(np.uint8), kind="stable")
        borders = np.searchsorted(groups[order], np.arange(GROUPS + 1)).tolist()
        around, total, h, inner = around[order], total[order], h[order], (targets % GROUP_WORDS)[order]
        error = -soft_max(h @ self.group + self.group_bias)
        error[np.arange(len(targets)), groups[order]] += 1
        to_h = error @ self.group.T
        self._move("group", (h.T @ error) * share, rate)
        self._move("group_bias", error.sum(axis=0) * share, rate)
        for g in range(GROUPS):
            a, b = borders[g], borders[g + 1]
            if a < b:
                error = -soft_max(h[a:b] @ self.word[g] + self.word_bias[g])
                error[np.arange(b - a), inner[a:b]] += 1
                to_h[a:b] += error @ self.word[g].T
                self._move("word", (h[a:b].T @ error) * share, rate, g)
                self._move("word_bias", error.sum(axis=0) * share, rate, g)
        back = to_h * (1 - h * h)
        to_total = back @ self.hidden.T
        self._move("hidden", (total.T @ back) * share, rate)
        for j in range(2 * SIDE):
            # rows of one word are added up first, so that a word changes once per step
            by_word = np.argsort(around[:, j].astype(np.uint16), kind="stable")
            sorted_words = around[by_word, j]
            heads = np.flatnonzero(np.diff(sorted_words, prepend=-1))
            rows, gradient = sorted_words[heads], np.add.reduceat(to_total[by_word], heads, axis=0) * share
            squares = self.square["near"][j]
            squares[rows] += (gradient * gradient).mean(axis=1)
            self.near[j, rows] += rate * gradient / np.sqrt(squares[rows])[:, None]


def log_sum(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=1)
    return top + np.log(np.exp(scores - top[:, None]).sum(axis=1))


def soft_max(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def windows(targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words around each word of a text, with an edge entry beyond its ends."""
    ends = np.cumsum(counts)
    place = np.arange(len(targets)) - np.repeat(ends - counts, counts)
    left = np.repeat(counts, counts) - 1 - place
    around = np.full((len(targets), 2 * SIDE), EDGE, np.int64)
    for k in range(1, SIDE + 1):
        has = place >= k
        around[has, SIDE - k] = targets[np.flatnonzero(has) - k]
        has = left >= k
        around[has, SIDE + k - 1] = targets[np.flatnonzero(has) + k]
    return around


def targets_of(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entry of every word of all texts, and the number of words of each text."""
    targets, counts, *_ = coded_targets(texts, vocabulary)
    return targets, counts


def coded_targets(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The same, and the codes and distinct words of all that are outside the vocabulary."""
    words, counts = words_of(pc.utf8_lower(texts.cast(pa.large_string())))
    codes, distinct = coded(words)
    entries = pc.fill_null(pc.index_in(distinct, vocabulary), UNKNOWN).to_numpy(zero_copy_only=False).astype(np.int64)
    targets = entries[codes] if len(codes) else np.zeros(0, np.int64)
    outside = entries == UNKNOWN
    place = np.cumsum(outside) - 1
    return targets, counts, place[codes[targets == UNKNOWN]] if len(codes) else np.zeros(0, np.int64), distinct.filter(pa.array(outside))


def _count_words(batches):
    for block in blocks(batches):
        words, _ = words_of(pc.utf8_lower(block.column("text").cast(pa.large_string())))
        counted = pc.value_counts(words)
        if len(counted):
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts")], ["word", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of every distinct word of the corpus, written once."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return staged(rows.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary_of(counts: DataFrame) -> list[str]:
    """Two reserved entries and the most frequent words of the corpus; a fixed number."""
    return list(entry_counts(counts))


def entry_counts(counts: DataFrame) -> dict[str, int]:
    """The vocabulary with the words of each entry in the corpus."""
    frequent = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - 2).collect()
    known = {row["word"]: row["n"] for row in frequent}
    n_words = counts.agg(F.sum("n")).first()[0] or 0
    return {"": n_words - sum(known.values()), " ": 0} | known  # no word is empty or a space


def _encode(words: list[str]):
    """The entries of each text that has a word."""

    def encoded(batches):
        vocabulary = pa.array(words, pa.large_string())
        for block in blocks(batches):
            targets, counts = targets_of(block.column("text"), vocabulary)
            ends = np.cumsum(counts)
            raw = [targets[e - n : e].astype("<u2").tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(raw, pa.binary())], ["key", "entries"]).filter(pa.array(counts > 0))

    return encoded


def _entries(batches):
    """Entries of all texts of a block, and the number of each text."""
    for block in blocks(batches, ENTRY_BYTES):
        raw = block.column("entries").to_pylist()
        yield np.frombuffer(b"".join(raw), "<u2").astype(np.int64), np.array([len(x) // 2 for x in raw], np.int64)


def _train(state: np.ndarray, size: int):
    """All texts of a task, block by block; the parameters leave in slices with the number of words they saw."""

    def trained(batches):
        network, n_seen = Network(state[:size].copy(), state[size:].copy()), 0
        for targets, counts in _entries(batches):
            around = windows(targets, counts)
            # stretches of neighbouring words from all over the block in one batch
            n_batches = max(1, -(-len(targets) // BATCH), min(BLOCK_BATCHES, len(targets) // LEAST_BATCH))
            for k in range(n_batches):
                own = slice(k, None, n_batches)
                network.train(around[own], targets[own], RATE)
            n_seen += len(targets)
        if n_seen:
            for k, part in enumerate(np.array_split(np.concatenate([network.flat, network.squares]), SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n_seen], pa.int64()), pa.array([part.astype("<f4").tobytes()], pa.binary())], ["slice", "n", "parameters"])

    return trained


def _held_out(flat: np.ndarray):
    def measured(batches):
        network = Network(flat.copy())
        for targets, counts in _entries(batches):
            around = windows(targets, counts)
            total = sum(float(network.log_probabilities(around[a : a + 65536], targets[a : a + 65536]).sum(dtype=np.float64)) for a in range(0, len(targets), 65536))
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([len(targets)], pa.int64())], ["total", "n"])

    return measured


def _average(batches):
    """The average of each slice, weighted by words."""
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for k, n, blob in zip(*(batch.column(x).to_pylist() for x in ("slice", "n", "parameters")), strict=True):
            own = np.frombuffer(blob, "<f4").astype(np.float64) * n
            sums[k] = sums[k] + own if k in sums else own
            seen[k] = seen.get(k, 0) + n
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sorted(sums), pa.int32()), pa.array([(sums[k] / seen[k]).astype("<f4").tobytes() for k in sorted(sums)], pa.binary())], ["slice", "parameters"])


def _round(texts: DataFrame, n_tasks: int, state: np.ndarray, size: int) -> np.ndarray:
    """Every task trains on its texts from the same state, in the order of their keys; the average of the tasks.

    The state: `size` parameters and the squares of their gradients.
    """
    dealt = texts.repartitionById(n_tasks, "task").sortWithinPartitions("key", "entries").select("entries")
    slices = dealt.mapInArrow(_train(state, size), "slice int, n long, parameters binary").repartitionById(SLICES, "slice")
    averaged = slices.mapInArrow(_average, "slice int, parameters binary").collect()
    if not averaged:
        return state
    return np.concatenate([np.frombuffer(row["parameters"], "<f4") for row in sorted(averaged, key=lambda r: r["slice"])])


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counts: DataFrame | None = None) -> tuple[list[str], np.ndarray]:
    """The vocabulary, and the parameters after PASSES passes, or fewer if held-out texts stop gaining.

    A pass is a few rounds of disjoint texts, each of which starts from the average of the one before.
    """
    prepare(docs.sparkSession)
    counts = word_counts(docs, text) if counts is None else counts
    entries = entry_counts(counts)
    words, n_words, network = list(entries), sum(entries.values()), Network()
    if not n_words:
        return words, network.flat
    of_entry = np.zeros(VOCABULARY)
    of_entry[: len(words)] = list(entries.values())
    network.start_from(of_entry)
    state, size = np.concatenate([network.flat, network.squares]), len(network.flat)
    # tasks and rounds follow from the number of words, not from the layout of files
    task_words = max(TASK_WORDS, TASK_WORDS_GROWTH * n_words**0.5)
    n_tasks = max(1, round(n_words / task_words))
    n_rounds = max(1, min(ROUNDS, int(n_words / n_tasks / ROUND_WORDS)))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(*([F.col(doc_id)] if doc_id in docs.columns else []), whole).alias("key"), whole.alias("text"))
    texts = staged(rows.mapInArrow(_encode(words), "key long, entries binary"), "entries").select(
        "key", "entries", (F.pmod("key", F.lit(HELD_OUT)) == 0).alias("held"),
        F.pmod(F.shiftright("key", 8), F.lit(n_tasks)).cast("int").alias("task"), F.pmod(F.shiftrightunsigned("key", 40), F.lit(n_rounds)).alias("round"),
    )
    trained, held = (texts, None) if PASSES == 1 else (texts.filter("NOT held"), texts.filter("held"))
    if held is not None and (held.isEmpty() or trained.isEmpty()):  # a few texts only
        trained = held = texts
    best, value = state, -np.inf
    for _ in range(PASSES):
        for k in range(n_rounds):
            state = _round(trained.filter(F.col("round") == k), n_tasks, state, size)
        if held is None:
            return words, state[:size]
        total, n = held.select("entries").mapInArrow(_held_out(state[:size]), "total double, n long").agg(F.sum("total"), F.sum("n")).first()
        before, now = value, total / n
        if now > value:
            best, value = state, now
        if not now > before + LEAST_GAIN:
            break
    return words, best[:size]


def _bigrams(batches):
    """How often each byte follows another in the distinct words; END stands before the first and after the last."""
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        cells, _ = spelled(batch.column("word"))
        total += np.bincount(cells, minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbouring bytes of all words one after the other, as cells of a table, and their number per word."""
    words = words.cast(pa.large_string())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    heads = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.full(int((lengths + 1).sum()) + 1, END, np.int64)
    symbols[ranges(heads + 1, lengths)] = np.frombuffer(b"".join(x.encode() for x in words.to_pylist()), np.uint8)
    return symbols[:-1] * SYMBOLS + symbols[1:], lengths + 1


@dataclass
class RareWords:
    """P(word | UNKNOWN) for every string: its share of the corpus's words outside the vocabulary, mixed with its spelling.

    The share left to spelling is that of words seen for the first time.  The table of words stays distributed.
    """

    table: DataFrame
    n_words: int
    n_distinct: int
    bigrams: np.ndarray

    def log_probabilities(self, words: pa.Array, seen: np.ndarray) -> np.ndarray:
        """Of distinct words that were seen so often in the corpus."""
        return rare_log_probabilities(words, seen, self.n_words, self.n_distinct, self.bigrams)


def rare_log_probabilities(words: pa.Array, seen: np.ndarray, n_words: int, n_distinct: int, bigrams: np.ndarray) -> np.ndarray:
    if len(words) == 0:
        return np.zeros(0)
    cells, counts = spelled(words)
    spelling = np.add.reduceat(bigrams[cells], np.cumsum(counts) - counts)
    if not n_words:
        return spelling
    with np.errstate(divide="ignore"):
        share = np.log(seen.astype(np.float64))
    return np.logaddexp(share, np.log(n_distinct) + spelling) - np.log(n_words + n_distinct)


def rare_words(counts: DataFrame, words: list[str]) -> RareWords:
    """The words of the corpus outside the vocabulary."""
    known = F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in words], "word string"))
    table = counts.join(known, "word", "left_anti")
    n_words, n_distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = np.ones(SYMBOLS * SYMBOLS)
    for cell, n in table.select("word").mapInArrow(_bigrams, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        found[cell] += n
    found = found.reshape(SYMBOLS, SYMBOLS)
    return RareWords(table, n_words, n_distinct, np.log(found / found.sum(axis=1, keepdims=True)).reshape(-1))


def score_words(docs: DataFrame, words: list[str], parameters: np.ndarray, rare: RareWords, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `score`, with every word outside the vocabulary at its own probability.

    A block of texts travels as its classes' sums and the codes of its rare words; its distinct rare words are joined to
    the counts of the corpus, and the counts return to their block.
    """
    prepare(docs.sparkSession)

    def posted(batches):
        network, vocabulary = Network(np.array(parameters, np.float32)), pa.array(words, pa.large_string())
        task = TaskContext.get().partitionId() << 32
        for number, block in enumerate(blocks(batches, SCORED_BYTES)):
            targets, counts, codes, distinct = coded_targets(block.column("text"), vocabulary)
            sums = class_sums(network, targets, counts)
            unknown = targets == UNKNOWN
            n_unknown = per_text(unknown.astype(np.float64), counts).astype(np.uint32) if len(targets) else np.zeros(len(counts), np.uint32)
            ids = block.column("doc_id")
            blob = packed(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), counts.astype(np.uint32), sums, n_unknown, codes.astype(np.uint32))
            own = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), pa.array([blob], pa.binary()), own], ["block", "payload", "words"])

    n_words, n_distinct, bigrams = rare.n_words, rare.n_distinct, rare.bigrams

    def summed(batches):
        for batch in batches:
            for blob, own, seen in zip(batch.column("payload").to_pylist(), batch.column("words"), batch.column("seen"), strict=True):
                ids, no_id, counts, sums, n_unknown, codes = unpacked(blob)
                n = np.zeros(len(own), np.int64)
                if seen.is_valid and len(seen):
                    n[seen.values.field("at").to_numpy()] = seen.values.field("n").to_numpy()
                if len(codes):
                    sums = sums + per_text(rare_log_probabilities(own.values, n, n_words, n_distinct, bigrams)[codes], n_unknown.astype(np.int64))
                counts = counts.astype(np.int64)
                mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=no_id > 0), pa.array(counts), pa.array(sums), mean], ["doc_id", "n_words", "log_probability", "mean_log_probability"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    posts = staged(rows.mapInArrow(posted, "block long, payload binary, words array<string>"), "blocks")
    each = posts.select("block", F.posexplode("words").alias("at", "word"))
    seen = each.join(rare.table, "word").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("seen"))
    return posts.join(seen, "block", "left").select("payload", "words", "seen").mapInArrow(summed, "doc_id long, n_words long, log_probability double, mean_log_probability double")


def class_sums(network: Network, targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    around = windows(targets, counts)
    found = [network.log_probabilities(around[a : a + 65536], targets[a : a + 65536]) for a in range(0, len(targets), 65536)]
    return per_text(np.concatenate(found).astype(np.float64), counts) if found else np.zeros(len(counts))


def score(docs: DataFrame, words: list[str], parameters: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, log_probability (sum over words), mean_log_probability of every row, by the network alone.

    Words outside the vocabulary count as one entry here; `score_words` gives each its own probability.
    """
    prepare(docs.sparkSession)

    def scored(batches):
        network, vocabulary = Network(np.array(parameters, np.float32)), pa.array(words, pa.large_string())
        for block in blocks(batches):
            targets, counts = targets_of(block.column("text"), vocabulary)
            sums = class_sums(network, targets, counts)
            mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums), mean], ["doc_id", "n_words", "log_probability", "mean_log_probability"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, n_words long, log_probability double, mean_log_probability double")
