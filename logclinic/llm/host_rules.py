"""Quality rules with verdicts per host: JVM expressions only.

Each text is measured inside its row, without exploding words.  A text fails a rule by its own measures; the failures of
each rule are added up per host, the rates are shrunk with a beta prior fitted to all hosts by moments, and a host whose
shrunk rate is too high under any rule is rejected with all its texts.

Null and empty texts have no words and fail.  Texts without a host form a host of their own.  Rows with equal ids are
judged one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logclinic.llm.staging import staged

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: A host is rejected if the shrunk rate of a rule exceeds this.
MOST_FAILING = 0.6
#: Bounds on the weight of the prior, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)

SPACE = r"[ \t-\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: a lambda's variable is a computed value, a column is an expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    A window's hash and its place share one long, so that equal windows are neighbours after a sort of plain longs.
    """

    def counted(w: Column, n: Column) -> Column:
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def keyed(b: Column, mask: Column) -> Column:
            key = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))
            return F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key))

        def places(keys: Column, mask: Column) -> Column:
            head = lambda k: k.bitwiseAND(F.bitwise_not(mask))
            same = lambda k, j: F.coalesce(head(F.get(keys, j)) == head(k), F.lit(False))
            twice = F.filter(keys, lambda k, i: same(k, i - 1) | same(k, i + 1))
            return F.sort_array(F.transform(twice, lambda k: k.bitwiseAND(mask)))

        def covered(at: Column) -> Column:
            own = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x)

        return let(low, lambda mask: let(keyed(bits, mask), lambda keys: let(places(keys, mask), covered)))

    return F.when(F.size(words) < 6, counted_small(words)).otherwise(counted(words, F.size(words)))


def counted_small(words: Column) -> Column:
    """The same for texts of at most five words, whose windows are compared directly."""
    w = lambda i: F.get(words, F.lit(i))
    equal = lambda i, j: F.coalesce((w(i) == w(j)) & (w(i + 1) == w(j + 1)) & (w(i + 2) == w(j + 2)), F.lit(False))
    first, second, both = equal(0, 1), equal(0, 2), equal(1, 2)
    return F.when(second, 5).when(first | both, 4).otherwise(0).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """word_chars, n_symbols, n_dup_lines and, of the words, n_words and n_repeat_words of a text that is not null."""
    letters = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, SPACES, "") != "")
    return {
        "word_chars": F.char_length(letters).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "of_words": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))),
    }


def shrunk_rates(failures: DataFrame, rules: list[str]) -> DataFrame:
    """Host, documents, and for each rule the rate shrunk to the prior that all hosts' rates suggest."""
    parts = []
    for r in rules:
        rate = F.col(f"n_{r}") / F.col("n_docs")
        parts += [F.sum(f"n_{r}").alias(f"all_{r}"), F.var_pop(rate).alias(f"var_{r}")]
    prior = failures.agg(F.sum("n_docs").alias("all_docs"), *parts)
    low, high = PRIOR_WEIGHT
    for r in rules:
        mean = F.col(f"all_{r}") / F.col("all_docs")
        weight = F.when(F.col(f"var_{r}") > 0, mean * (1 - mean) / F.col(f"var_{r}") - 1).otherwise(high)
        prior = prior.withColumn(f"mean_{r}", mean).withColumn(f"weight_{r}", F.least(F.greatest(weight, F.lit(low)), F.lit(high)))
    joined = failures.withColumn("one", F.lit(1)).join(F.broadcast(prior.withColumn("one", F.lit(1))), "one")  # the prior is one row
    shrunk = [((F.col(f"n_{r}") + F.col(f"weight_{r}") * F.col(f"mean_{r}")) / (F.col("n_docs") + F.col(f"weight_{r}"))).alias(f"rate_{r}") for r in rules]
    return joined.select("host", "n_docs", *shrunk)


def judge(docs: DataFrame, most_failing: float = MOST_FAILING, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, host_rejected and kept of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    measured = rows.select("doc_id", "host", *(c.alias(name) for name, c in measures(F.col("text")).items()))
    measured = measured.select("*", "of_words.*").drop("of_words")
    rules = {
        "short": F.col("n_words") < LEAST_WORDS,
        "repeated": F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT,
        "symbols": F.col("n_symbols") * 10 > F.col("word_chars"),
    }
    measured = staged(measured.withColumns({f"fails_{r}": c for r, c in rules.items()}).withColumn("base_failed", F.col("fails_short") | F.col("fails_repeated")), "measures")
    salt = F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(16))
    sums = [F.count("*").alias("n_docs"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"n_{r}") for r in rules)]
    rejected = shrunk_rates(measured.groupBy("host").agg(*sums), list(rules))
    rejected = rejected.select(F.col("host").alias("of_host"), F.greatest(*(F.col(f"rate_{r}") for r in rules)).alias("rate")).filter(F.col("rate") > most_failing)
    # rejected hosts once per salt, so that a large host is spread over many tasks
    rejected = rejected.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    salted = measured.withColumn("salt", salt)
    judged = salted.join(rejected, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt") == F.col("of_salt")), "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rate").isNull()).alias("kept"), F.col("rate").isNotNull().alias("host_rejected"),
    )
