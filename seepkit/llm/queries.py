"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seepkit.llm.token_files import token_file_digest, write_tokens

    path = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "words", end_id=1)
    return token_file_digest(spark, path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seepkit.llm.toxicity import toxic_scores

    scored = toxic_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_poor", "p_toxic", "is_toxic")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seepkit.llm.near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from seepkit.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seepkit.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seepkit.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seepkit.llm.quality import BASE, score

    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return scored.select("doc_id", *(scored.m[c].alias(c) for c in BASE), "base_failed", "kept", "quality")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seepkit.llm.byte_bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from seepkit.llm.main_text import extract

    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seepkit.llm.substrings import substring_digest

    return substring_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seepkit.llm.lexicon import build_lexicon, round_trip_digest

    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    return round_trip_digest(docs, path, build_lexicon(docs, path))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seepkit.llm.conversations import repair_digest

    return repair_digest(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seepkit.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from seepkit.llm.oracles import SQL

    return SQL
