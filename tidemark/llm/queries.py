"""The registered query of each operator, over whole tables, with its SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def held_out() -> Column:
    """Of a labelled document: whether it is kept for measuring, never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.neighbour_quality import score_quality

    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_classes

    return exact_classes(_table(spark, sf_dir, "documents"), stays="max")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_files import read_token_files, write_token_files

    read = read_token_files(spark, write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))
    return read.select("doc_id", "start", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_minhash import dedup_lines

    cleaned = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_suffix_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_ranges import dedup_bytes

    cleaned = dedup_bytes(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents")).select("doc_id", F.col("n_ngrams").alias("n_shingles"), "component_id")


def op7_piece_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.piece_prefix import encode_decode

    coded = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.doc_rules import apply_rules

    return apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprint_index import dedup_windows

    cleaned = dedup_windows(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


QUERIES = {
    "op1_neighbour_quality": op1_neighbour_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_files": op3_token_files,
    "op4_line_minhash": op4_line_minhash,
    "op5_suffix_ranges": op5_suffix_ranges,
    "op6_ngram_join": op6_ngram_join,
    "op7_piece_prefix": op7_piece_prefix,
    "op8_boosted_rules": op8_boosted_rules,
    "op9_fingerprint_index": op9_fingerprint_index,
    "op10_source_mix": op10_source_mix,
}

ORACLES = {
    "op2_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
}
