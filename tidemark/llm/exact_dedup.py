"""Exact deduplication with DataFrame functions only.

Rows are grouped by a 128-bit content hash and, inside a hash group, by the text itself, so equal hashes of different
texts stay apart: the text is part of the grouping key and Spark compares its bytes. Counting is partial before the
shuffle, so a text that a third of all rows share arrives as one row per task. The classes are written without their
texts; the join back goes by (hash, sha256), plain exchanges on both sides, which adaptive execution may split.

Defined cases: null and empty texts are the same, empty text; rows with a null id take part, never stay while their
text has a row with an id, and a class with null ids only keeps null; rows repeating both id and text are one document
and share one result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import postings as P
from tidemark.llm.shared import materialise


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "min", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    stays: "min" keeps the smallest id of equal texts, "max" the largest.
    """
    best = {"min": F.min, "max": F.max}[stays]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    classes = (
        base.groupBy(hash_of(F.col("__text")).alias("__hash"), "__text")
        .agg(best("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("__hash", F.sha2("__text", 256).alias("__sha"), "keep_id", "group_size")
    )
    classes = materialise(classes, "exact_classes").select(F.col("__hash").alias("__h"), F.col("__sha").alias("__s"), "keep_id", "group_size")
    rows = base.select("__id", hash_of(F.col("__text")).alias("__hash"), F.sha2("__text", 256).alias("text_sha256"))
    joined = rows.join(classes, (F.col("__hash") == F.col("__h")) & (F.col("text_sha256") == F.col("__s")))
    return joined.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "min") -> DataFrame:
    """The input's rows and columns without the copies."""
    kept = exact_classes(docs, id_col, text_col, stays).filter("kept").select(F.col(id_col).alias("__keep"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__keep"]) & (sha == kept["__sha"]), "left_semi")


def row_key(number: Column, text: Column) -> tuple[Column, Column]:
    """(id, row): null ids as the smallest number; row is a hash of id and text."""
    number = F.coalesce(number.cast("long"), F.lit(-(1 << 63)))
    return number, F.xxhash64(number, F.sha2(F.coalesce(text, F.lit("")), 256))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, row, text) and more: null ids as the smallest number; (id, row) is the key of a document, row a hash of id and text.

    Rows that repeat an id have one key only if their texts are equal too.
    """
    number, row = row_key(F.col(id_col), F.col(text_col))
    return docs.select(*more, number.alias("id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def split_copies(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of keyed rows: the keys (id, row) of those whose text has a smaller id, and the rows of all others."""
    classes = materialise(exact_classes(rows, "id", "text", "min").select("id", F.xxhash64("id", "text_sha256").alias("row"), "kept"), f"{name}_classes")
    copies = materialise(classes.filter("not kept").select("id", "row").distinct(), f"{name}_copies")
    sure, open_rows = P.split(rows, copies, "row")
    return copies, sure.unionAll(open_rows.join(copies, ["id", "row"], "left_anti").select(*rows.columns))
