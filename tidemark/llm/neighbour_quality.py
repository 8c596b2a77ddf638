"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms are hashed: 4,096 pairs of neighbouring character classes, 1,024 folded words and a few marks of repetition. A
sample of at most MAX_TRAIN labelled rows (by hash order of the id) gives the inverse document frequencies, the
truncated singular vectors and the labelled vectors; all three have sizes fixed by parameters and are broadcast. Every
document is projected, its cosine products with all labelled vectors are computed exactly in blocks, and the labels of
the NEIGHBOURS nearest count by similarity.

Defined cases: a null or empty text, or one without any known term, scores the mean label of the sample; null labels
are ignored; several labels of an id count by their mean; without labels every document scores 1; rows that repeat an id
are scored each, and the smallest text of an id is learnt; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.shared import lean

MAX_TRAIN = 4_000
DIMENSIONS = 64
NEIGHBOURS = 16
BLOCK = 256
PAIRS, WORDS, MARKS = 4096, 1024, 8
TERMS = PAIRS + WORDS + MARKS
#: Marks of repetition are few among thousands of terms and count as so many occurrences each.
MARK_WEIGHT = 12.0


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for i in range(26):
        table[97 + i] = 1 + i
        table[65 + i] = 27 + i % 6
    table[48:58] = 33
    for i, c in enumerate(b" \n\t.,;:!?#*$%&|<>-'\"()/=_@"):
        table[c] = 34 + i
    table[128:] = 60 + (np.arange(128) >> 5)
    return table


_CLASS = _classes()


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log(1 + occurrences) of TERMS terms for each text, float32."""
    n = len(offsets) - 1
    codes = _CLASS[data]
    doc = K.doc_of(offsets)
    pairs = codes[:-1] * 64 + codes[1:]
    inside = doc[:-1] == doc[1:]
    counts = np.zeros((n, TERMS), np.float32)
    counts[:, :PAIRS] = np.bincount((doc[:-1] * PAIRS + pairs)[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    starts, ends, word_offsets = K.words(data, offsets)
    hashes = K.Rolling(data, K.FOLDED).of(starts, ends)
    word_doc = K.doc_of(word_offsets)
    counts[:, PAIRS : PAIRS + WORDS] = np.bincount(word_doc * WORDS + (hashes >> np.uint64(54)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    np.log1p(counts, out=counts)
    words = np.maximum(np.diff(word_offsets), 1)
    same = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    at, tri = K.windows(hashes, word_offsets, 3)
    order, first = K.run_ranks(tri, word_doc[at])
    again = np.bincount(word_doc[at][order[~first]], minlength=n) / words
    symbols = np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))
    upper = (data >= 65) & (data <= 90)
    share = lambda flags: np.bincount(doc[flags], minlength=n) / words
    marks = [np.bincount(word_doc[1:][same], minlength=n) / words, again, share(symbols), share(data == 124), share(upper) / 4, share(data == 33), 10 / words, share((data >= 48) & (data <= 57)) / 4]
    for i, mark in enumerate(marks):
        counts[:, PAIRS + WORDS + i] = MARK_WEIGHT * np.minimum(np.sqrt(mark), 2) * (np.diff(offsets) > 0)
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_space(counts: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Projection (terms, dimensions) with the document frequencies in it, and the unit vectors of the rows.

    Randomised subspace iteration in place of a full decomposition.
    """
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    weighted = _unit(counts * weight.astype(np.float32))
    basis = np.random.default_rng(seed).standard_normal((weighted.shape[1], dimensions + 8)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, rotation = np.linalg.svd(weighted @ basis, full_matrices=False)
    basis = (basis @ rotation.T)[:, :dimensions]
    return (weight[:, None] * basis).astype(np.float32), _unit(weighted @ basis).astype(np.float32)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted mean label of the nearest known vectors, from exact cosine products in blocks."""
    out = np.full(len(vectors), labels.mean() if len(labels) else 1.0)
    k = min(neighbours, len(labels))
    if not k:
        return out
    for start in range(0, len(vectors), BLOCK):
        block = vectors[start : start + BLOCK]
        products = block @ known.T
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(products, near, axis=1), 0).astype(np.float64) ** 16
        total = weight.sum(axis=1)
        found = total > 1e-12
        out[start : start + BLOCK][found] = (weight * labels[near]).sum(axis=1)[found] / total[found]
    return np.clip(out, 0.0, 1.0)


def _fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None, id_col: str, text_col: str, label_col: str, max_train: int) -> Callable[[pa.Array], np.ndarray]:
    """A function that scores an array of texts on the executors."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("double").alias("label")).filter(F.col("label").isNotNull())
    if learn_from is not None:
        marks = marks.filter(learn_from)
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.avg("label").alias("label")).join(rows.select("id").distinct(), "id", "left_semi")
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(max_train)
    # at most max_train rows of (id, label)
    picked = spark.createDataFrame([(r.id, r.label) for r in chosen.collect()], "id long, label double")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, rows=512):
            counts = term_counts(*K.utf8(batch.column("text"))).astype(np.float16)
            packed = []
            for row in counts:
                at = np.flatnonzero(row)
                packed.append(at.astype(np.uint16).tobytes() + row[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())], names=["id", "label", "packed"])

    # one text of an id, whatever the order of rows
    texts = rows.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    learnt = texts.select("id", "text", "label").mapInArrow(count, "id long, label double, packed binary").collect()
    learnt = sorted(learnt, key=lambda r: r.id)
    if learnt:
        counts = np.zeros((len(learnt), TERMS), np.float32)
        for i, r in enumerate(learnt):
            half = len(r.packed) // 2
            counts[i, np.frombuffer(r.packed[:half], np.uint16)] = np.frombuffer(r.packed[half:], np.float16)
        projection, known = fit_space(counts)
        values = np.array([r.label for r in learnt])
        del counts, learnt
    else:
        projection, known, values = np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0)
    model = spark.sparkContext.broadcast((projection, known, values))

    def scores(texts: pa.Array) -> np.ndarray:
        projection, known, values = model.value
        return vote(_unit(term_counts(*K.utf8(texts)) @ projection), known, values)

    return scores


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per input row: id, score. learn_from: condition on id that a labelled row must meet to be learnt from."""
    scores = _fit(docs, labels, learn_from, id_col, text_col, label_col, max_train)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, rows=512):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores(batch.column("text")))], names=[id_col, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """The input's rows and columns, without rows that score less; nothing is shuffled."""
    scores = _fit(docs, labels, learn_from, id_col, text_col, label_col, max_train)
    place = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # by number, as other columns may have any names
            named = pa.RecordBatch.from_arrays([*whole.columns, whole.column(place)], names=[*(f"c{i}" for i in range(whole.num_columns)), "text"])
            for batch in K.slices(iter([named]), rows=512):
                good = batch.filter(pa.array(scores(batch.column("text")) >= least))
                yield pa.RecordBatch.from_arrays(good.columns[:-1], names=whole.schema.names)

    return docs.mapInArrow(run, docs.schema)
