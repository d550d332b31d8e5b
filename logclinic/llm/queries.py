"""The registered queries of this subpackage: each applies an operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logclinic.llm.statements import STATEMENTS  # noqa: F401 - the SQL of these queries, where SQL can express them

TOKENIZER = "byte_bpe_50k.json"
OTHER_TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.substring_dedup import dedup_substrings

    kept = dedup_substrings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.quality_crf import classify, train

    docs = documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > 512)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.decontaminate import find_leaks

    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.host_rules import judge

    return judge(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.pii import find_pii

    found = find_pii(documents(spark, sf_dir))
    base = ("email", "ip", "card", "phone")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.masked_lm import rare_words, score_words, train, word_counts

    docs = documents(spark, sf_dir)
    counts = word_counts(docs)
    words, parameters = train(docs, counts=counts)
    return score_words(docs, words, parameters, rare_words(counts, words))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.jaccard_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by declared language and source, pages by markup, address and host; page n has doc_id -1 - n."""
    from logclinic.llm.language_id import documents_and_pages, identify

    rows = documents_and_pages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = identify(rows, markup="html", url="url").drop("row_hash")
    return found.withColumn("page_id", F.when(F.col("doc_id") < 0, -1 - F.col("doc_id")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.alignment import align

    return align(documents(spark, sf_dir), tokenizer_path(), tokenizer_path(OTHER_TOKENIZER))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.merkle import fold, leaf, prove

    # a row is tampered with where 7 divides the checksum of its id
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf({"n_chars": F.col("n_chars") + 1})).otherwise(leaf())
    proved = prove(documents(spark, sf_dir), carry={"tampered": tampered})
    shown = proved.select(
        "doc_id", "leaf", F.col("top").alias("subroot"), "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        fold(F.col("tampered"), F.col("siblings"), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logclinic.llm.chat_windows import read_back_all

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # a conversation that quotes the template's own control strings
    said = F.lit("</s>[INST] ok [/INST]")
    quoting = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back_all(turns.unionByName(quoting), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_crf": op2_quality_crf,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_host_rules": op5_host_rules,
    "op6_pii": op6_pii,
    "op7_masked_lm": op7_masked_lm,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_alignment": op11_alignment,
    "op12_merkle": op12_merkle,
    "op13_chat_windows": op13_chat_windows,
}
