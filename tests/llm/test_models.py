"""Models trained here: the line classifier and the masked language model; and the pipeline."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from logclinic.llm import masked_lm, quality_crf
from logclinic.llm.decontaminate import normal
from logclinic.llm.queries import QUERIES
from logclinic.llm.staging import staged
from tests.llm import plain
from tests.llm.conftest import SMALL, pairs_of

TRAINED = "/root/testdata/sf0.01"


def test_forward_backward_sums_over_all_paths():
    pick = np.random.default_rng(2)
    counts = np.array([3, 0, 5, 1])
    good, joint = pick.uniform(0.1, 0.9, 9), pick.uniform(0.2, 2, (2, 2))
    marginal, pairs = quality_crf.forward_backward(good, counts, joint)
    at = 0
    for doc, n in enumerate(counts.tolist()):
        total, states, edges = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n) if n else ():
            weight = np.prod([good[at + k] if s else 1 - good[at + k] for k, s in enumerate(path)]) * np.prod([joint[a, b] for a, b in itertools.pairwise(path)])
            total += weight
            states += weight * np.array(path)
            for a, b in itertools.pairwise(path):
                edges[a, b] += weight
        if n:
            assert np.allclose(marginal[at : at + n], states / total) and np.allclose(pairs[doc], edges / total)
        at += n


def test_line_features():
    bins, lengths, counts = quality_crf.line_features(pa.array(["A line\n\nTHE THE THE", None, "", "###"]))
    assert counts.tolist() == [2, 0, 0, 1] and lengths.tolist() == [6, 11, 3] and bins.shape == (3, quality_crf.N_FEATURES)
    slots = quality_crf.with_neighbours(bins, counts)
    assert slots.min() >= 0 and slots.max() < 3 * quality_crf.N_FEATURES * quality_crf.BINS


def test_held_out_accuracy(spark):
    found = {r["doc_id"]: r for r in QUERIES["op2_quality_crf"](spark, TRAINED).collect()}
    labels = spark.read.parquet(f"{TRAINED}/labels.parquet").collect()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    unseen = [(found[r["doc_id"]]["predicted"], r["quality"]) for r in labels if found[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in unseen) >= 0.95 * len(unseen)


def test_held_out_labels_are_not_read(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", quality_crf.F.when(quality_crf.bucket(labels.doc_id) == 2, 1 - labels.quality).otherwise(labels.quality).cast("int"))
    one, two = quality_crf.train(small, labels), quality_crf.train(small, turned)
    assert np.array_equal(one.weights, two.weights) and one.offset == two.offset


def test_classifier_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (17, 0, 0), (21, 0, 0), (9, 1, None), (9, 1, 0), (None, 1, 0), (10, None, 1)], "doc_id long, quality int, toxic int")
    found = quality_crf.classify(odd, quality_crf.train(odd, labels)).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["score"] == 0 for r in found if r["doc_id"] in (0, 1, 2))
    assert quality_crf.classify(empty, quality_crf.train(empty, labels)).count() == 0
    even = quality_crf.classify(odd, quality_crf.train(odd, labels.limit(0))).collect()
    assert {round(r["score"], 6) for r in even} == {0.0, 0.5}


def test_gradient_of_the_network():
    """A step of training raises the probability of what it saw."""
    network = masked_lm.Network()
    pick = np.random.default_rng(3)
    around, targets = pick.integers(0, masked_lm.VOCABULARY, (64, 4)), pick.integers(0, masked_lm.VOCABULARY, 64)
    before = network.log_probabilities(around, targets).sum()
    for _ in range(20):
        network.train(around, targets, 0.1)
    assert network.log_probabilities(around, targets).sum() > before + 1
    all_words = np.arange(masked_lm.VOCABULARY)
    total = np.exp(network.log_probabilities(np.repeat(around[:1], len(all_words), axis=0), all_words)).sum()
    assert abs(total - 1) < 1e-3


def test_whole_texts_score_as_in_plain_python(spark):
    """Every word's log probability from a softmax over groups and one inside the group, summed over a whole text."""
    words = ["", " ", *"abcdefgh"]
    network = masked_lm.Network()
    network.start_from(np.arange(masked_lm.VOCABULARY) + 1.0)
    texts = ["a b c", "h", "", "a zz b  d\nq e f " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["log_probability"] for r in masked_lm.score(docs, words, network.flat).collect()}
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    for doc_id, text in enumerate(texts):
        own = [words.index(w) if w in words else masked_lm.UNKNOWN for w in text.split()]
        total = 0.0
        for k, target in enumerate(own):
            around = [own[k + d] if 0 <= k + d < len(own) else masked_lm.EDGE for d in (-2, -1, 1, 2)]
            h = np.tanh(sum(network.near[j, w].astype(float) for j, w in enumerate(around)) @ network.hidden.astype(float))
            g, i = divmod(target, masked_lm.GROUP_WORDS)
            total += soft(h @ network.group + network.group_bias)[g] + soft(h @ network.word[g] + network.word_bias[g])[i]
        assert abs(total - found[doc_id]) <= 1e-4 * max(1, len(own))


def test_training_starts_from_frequencies():
    network = masked_lm.Network()
    network.group[:], network.word[:] = 0, 0
    counts = np.random.default_rng(1).integers(1, 1000, masked_lm.VOCABULARY)
    network.start_from(counts)
    found = network.log_probabilities(np.zeros((masked_lm.VOCABULARY, 4), int), np.arange(masked_lm.VOCABULARY))
    assert np.allclose(found, np.log(counts / counts.sum()), atol=1e-4)


def test_windows_stay_inside_texts():
    around = masked_lm.windows(np.array([5, 6, 7, 8]), np.array([3, 0, 1]))
    edge = masked_lm.EDGE
    assert around.tolist() == [[edge, edge, 6, 7], [edge, 5, 7, edge], [5, 6, edge, edge], [edge] * 4]


def test_neighbours_help(spark):
    """On documents that were not trained on, the network beats the words' own frequencies, and order matters."""
    docs = spark.read.parquet(f"{TRAINED}/documents.parquet")
    words, parameters = masked_lm.train(docs.filter("doc_id % 5 != 0"))
    unseen = docs.filter("doc_id % 5 = 0")
    found = {r["doc_id"]: r for r in masked_lm.score(unseen, words, parameters).collect()}
    vocabulary = pa.array(words, pa.large_string())
    seen, _ = masked_lm.targets_of(pa.array([t for _, t in pairs_of(docs.filter("doc_id % 5 != 0"))]), vocabulary)
    own, _ = masked_lm.targets_of(pa.array([t for _, t in pairs_of(unseen)]), vocabulary)
    frequency = (np.bincount(seen, minlength=masked_lm.VOCABULARY) + 1) / (len(seen) + masked_lm.VOCABULARY)
    total, n = sum(r["log_probability"] for r in found.values()), sum(r["n_words"] for r in found.values())
    assert n == len(own) and total / n > np.log(frequency[own]).mean()


def test_language_model_on_odd_tables(odd, empty):
    words, parameters = masked_lm.train(odd)
    found = masked_lm.score(odd, words, parameters).collect()
    assert len(found) == odd.count()
    for r in found:
        assert (r["mean_log_probability"] is None) == (r["n_words"] == 0)
    assert all(r["log_probability"] == 0 for r in found if not r["n_words"])
    assert masked_lm.score(empty, *masked_lm.train(empty)).count() == 0


def test_layout_does_not_matter(spark):
    """One table in 4 and in 400 partitions trains and scores alike, and better than a start that has hardly moved."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = []
    for n in (4, 400):
        laid = docs.repartition(n)
        words, parameters = masked_lm.train(laid)
        found.append({r["doc_id"]: r["mean_log_probability"] for r in masked_lm.score(docs, words, parameters).collect()})
    few, many = found
    assert few.keys() == many.keys()
    assert max(abs(few[d] - many[d]) for d in few if few[d] is not None) < 0.01
    start = {r["doc_id"]: r["mean_log_probability"] for r in masked_lm.score(docs, words, masked_lm.Network().flat).collect()}
    mean = lambda scores: np.mean([x for x in scores.values() if x is not None])
    assert mean(many) > mean(start) + 2


def test_rare_junk_scores_below_prose(spark):
    """The query gives every word its own probability: texts of rare words only are the least likely ones."""
    found = {r["doc_id"]: r["mean_log_probability"] for r in QUERIES["op7_masked_lm"](spark, SMALL).collect()}
    texts = dict(pairs_of(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert found.keys() == texts.keys()
    counts = Counter(w for t in texts.values() for w in (t or "").lower().split())
    rare = lambda t: np.mean([counts[w] <= 2 for w in t.lower().split()])
    junk = [found[d] for d, t in texts.items() if t and t.split() and rare(t) > 0.9]
    prose = [found[d] for d, t in texts.items() if t and t.split() and rare(t) < 0.3]
    assert junk and prose and max(junk) < np.median(prose)


def test_rare_words_have_their_own_probability(spark, odd, empty):
    counts = masked_lm.word_counts(odd)
    words = masked_lm.vocabulary_of(counts)[:20]
    rare = masked_lm.rare_words(counts, words)
    table = {r["word"]: r["n"] for r in rare.table.collect()}
    assert table and not set(table) & set(words) and rare.n_words == sum(table.values()) and rare.n_distinct == len(table)
    each = np.exp(rare.log_probabilities(pa.array(list(table)), np.array(list(table.values()))))
    assert 0.5 < each.sum() < 1 and np.all(each >= np.array(list(table.values())) / (rare.n_words + rare.n_distinct) * (1 - 1e-9))
    flat = masked_lm.Network().flat
    own = lambda rows: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["log_probability"]) for r in rows), key=str)
    whole, classes = (own(f.collect()) for f in (masked_lm.score_words(odd, words, flat, rare), masked_lm.score(odd, words, flat)))
    vocabulary, texts = set(words), [(d is None, d or 0, (t or "")) for d, t in pairs_of(odd)]
    def more(t):
        own = [w.decode() for w in t.lower().encode().split() if w.decode() not in vocabulary]
        return rare.log_probabilities(pa.array(own, pa.string()), np.array([table[w] for w in own])).sum() if own else 0.0
    assert len(whole) == len(classes) == len(texts)
    assert np.isclose(sum(r[3] for r in whole), sum(r[3] for r in classes) + sum(more(t) for *_, t in texts))
    assert masked_lm.score_words(empty, words, flat, rare).count() == 0
    nothing = masked_lm.rare_words(masked_lm.word_counts(empty), ["", " "])
    assert all(r[3] < 0 for r in own(masked_lm.score_words(odd, ["", " "], flat, nothing).collect()) if r[2])


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), name)
        found.append(docs)
    return found


def test_pipeline_stages(spark, stages):
    docs, spoken, unique, clean, masked, packed = stages
    for one in stages[:-1]:
        assert one.schema == docs.schema
    assert spoken.count() >= 0.98 * docs.count()
    want = {d for d, _, c in plain.near_components(pairs_of(spoken)) if d == c}
    assert {d for d, _ in pairs_of(unique)} == want
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {d for d, t in pairs_of(unique) if any(i in normal(t) for i in items)}
    assert {d for d, _ in pairs_of(clean)} == want - leaked
    assert {d for d, _ in pairs_of(masked)} == {d for d, _ in pairs_of(clean)}
    assert all(not plain.base_spans(t) and n == len(t) for _, t, n in masked.select("doc_id", "text", "n_chars").collect())
    assert {r["doc_id"] for r in packed.collect()} == want - leaked


def test_run_is_the_stages_in_turn(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_of_odd_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SMALL), name)
