"""Substring deduplication by words over a log-structured index of window hashes.

The index knows, for history, the hashes of sampled windows (the anchors of all WINDOW-word windows, see anchors.py) as
immutable sorted runs: Parquet rows (bucket, payload) in the shared folder, a bucket being a range of hashes. Documents
come in batches of ascending id. A batch's sorted hashes are merge-joined with the runs bucket by bucket; hashes that
history or the batch itself has already are repeated, and the batch's hashes become a new run. After FANOUT runs a
compaction merges them into one.

Only windows whose anchor is repeated can be repeats. These are verified: whole windows are grouped by a second pair of
hashes over all their words (64 and 32 bits), and all that start later than the earliest (id, start) of a group go. A
slice of the input sends each window once, so a passage that very many documents share meets in one task once per slice only.

Defined cases: null and empty texts have no words; documents with equal texts are copies of the one with the smallest id
and lose all words if they have WINDOW or more; rows repeating both id and text are one document and share one result; other
rows that repeat an id are documents of their own, ordered among themselves by start alone, and of equal starts none
goes; rows with a null id count as the earliest and as repeating one id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import anchors as A
from tidemark.llm import postings as P
from tidemark.llm import textkit as K
from tidemark.llm.exact_dedup import keyed_rows, split_copies
from tidemark.llm.shared import discard, free_shuffles, lean, materialise, new_path, small_batches

WINDOW, ANCHOR = 20, 8
FANOUT, BATCHES = 3, 4
REPEAT = np.dtype([("key", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])
START = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, word_offsets = K.words(data, offsets)
    return K.Rolling(data).of(starts, ends), word_offsets


class FingerprintIndex:
    """Sorted immutable runs of hashes; add() returns what a batch has in common with history or itself."""

    def __init__(self, spark, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.runs: list[tuple[str, DataFrame]] = []

    def _write(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch: (bucket, payload) rows of sorted hashes, the lowest bit set where a slice has the hash twice. Returns (bucket, payload) of repeated hashes."""

        @lean
        def merge(table: pa.Table) -> pa.Table:
            old = np.array(table.column("run").to_pylist(), bool)
            parts = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("payload")]
            history = np.sort(np.concatenate([x for x, o in zip(parts, old, strict=True) if o] + [np.empty(0, np.uint64)]), kind="stable")
            new = np.concatenate([x for x, o in zip(parts, old, strict=True) if not o] + [np.empty(0, np.uint64)])
            double = K.distinct(new[new & np.uint64(1) == 1] & ~np.uint64(1))
            hashes, counts = K.counted(new & ~np.uint64(1))
            at = np.minimum(np.searchsorted(history, hashes), max(len(history) - 1, 0))
            known = history[at] == hashes if len(history) else np.zeros(len(hashes), bool)
            again = np.union1d(hashes[(counts > 1) | known], double)
            bucket = table.column("bucket")[0].as_py()
            return pa.table({"bucket": pa.array([bucket, bucket], pa.int32()), "payload": pa.array([again.tobytes(), hashes[~known].tobytes()], pa.binary()), "run": pa.array([False, True])})

        both = batch.select("bucket", "payload", F.lit(False).alias("run"))
        for _, run in self.runs:
            both = both.unionAll(run.select("bucket", "payload", F.lit(True).alias("run")))
        _, merged = self._write(both.groupBy("bucket").applyInArrow(merge, "bucket int, payload binary, run boolean"), f"merged_{len(self.runs)}")
        self.runs.append(self._write(merged.filter("run").select("bucket", "payload"), f"run_{len(self.runs)}"))
        if len(self.runs) > self.fanout:
            self.compact()
        return merged.filter("not run").select("bucket", "payload")

    def compact(self) -> None:
        """Merge all runs into one sorted run and drop the old ones."""

        @lean
        def merge(table: pa.Table) -> pa.Table:
            hashes = K.distinct(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("payload")]))
            return pa.table({"bucket": table.column("bucket").slice(0, 1), "payload": pa.array([hashes.tobytes()], pa.binary())})

        every = self.runs[0][1]
        for _, run in self.runs[1:]:
            every = every.unionAll(run)
        whole = self._write(every.groupBy("bucket").applyInArrow(merge, "bucket int, payload binary"), "compacted")
        for path, _ in self.runs:
            discard(self.spark, path)
        self.runs = [whole]


def anchor_hashes(rows: DataFrame, buckets: int, window: int, anchor: int) -> DataFrame:
    """(batch, bucket, payload): each slice's distinct anchor hashes, the lowest bit set where the slice has one twice."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in K.slices(batches):
            number = whole.column("batch").to_numpy()
            for b in np.unique(number):
                batch = whole.filter(pa.array(number == b))
                hashes, offsets = hashed_words(*K.utf8(batch.column("text")))
                at, grams = K.windows(hashes, offsets, anchor)
                _, chosen = A.stretches(at, grams, offsets, window, anchor)
                chosen = K.distinct(chosen)
                found, counts = K.counted(grams[np.searchsorted(at, chosen)] & ~np.uint64(1))
                yield A.hash_rows(found | (counts > 1).astype(np.uint64), buckets, {"batch": int(b)})

    return rows.mapInArrow(run, "bucket int, payload binary, batch int")


def repeated_starts(rows: DataFrame, repeats: A.RepeatFilter, buckets: int, window: int, anchor: int) -> DataFrame:
    """(doc, row, starts binary of 32-bit integers): windows that occur earlier; one row per document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            ids, own = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            hashes, offsets = hashed_words(*K.utf8(batch.column("text")))
            at, grams = K.windows(hashes, offsets, anchor)
            starts, chosen = A.stretches(at, grams, offsets, window, anchor)
            starts = starts[repeats(grams[np.searchsorted(at, chosen)] & ~np.uint64(1))]
            whole, keys = K.windows(hashes, offsets, window)
            _, checks = K.windows(hashes, offsets, window, seed=77)
            place = np.searchsorted(whole, starts)
            doc = np.searchsorted(offsets, starts, side="right") - 1
            records = np.empty(len(starts), REPEAT)
            records["key"], records["check"] = keys[place], (checks[place] >> np.uint64(32)).astype(np.uint32)
            records["doc"], records["row"], records["start"] = ids[doc], own[doc], starts - offsets[doc]
            records, first = _first(records)
            yield P.by_bucket(records[first], buckets)
            if len(rest := records[~first]):
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(rest["doc"][0] % buckets)], pa.int32()), pa.array([rest.tobytes()], pa.binary())], names=["bucket", "payload"])

    @lean
    def judge(table: pa.Table) -> pa.Table:
        records = np.concatenate([np.frombuffer(x.as_buffer(), REPEAT) for x in table.column("payload")])
        if table.column("bucket")[0].as_py() >= 0:
            records, first = _first(records)
            records = records[~first]
        out = np.empty(len(records), START)
        for c in START.names:
            out[c] = records[c]
        return pa.Table.from_batches([A.rows_by_doc(out, max(8, buckets // 16))])

    @lean
    def gather(table: pa.Table) -> pa.Table:
        records = np.concatenate([np.frombuffer(x.as_buffer(), START) for x in table.column("payload")])
        order, head = K.run_ranks(records["row"], records["doc"])
        records, at = records[order], np.flatnonzero(head)
        starts = [x["start"].tobytes() for x in np.split(records, at[1:])] if len(at) else []
        return pa.table({"doc": records["doc"][at], "row": records["row"][at], "starts": pa.array(starts, pa.binary())})

    found = rows.mapInArrow(run, "bucket int, payload binary").groupBy("bucket").applyInArrow(judge, "part int, payload binary")
    return found.groupBy("part").applyInArrow(gather, "doc long, row long, starts binary")


def _first(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct records by window and place, and which are at the earliest place (id, start) of their window."""
    records = records[np.lexsort((records["row"], records["start"], records["doc"], records["check"], records["key"]))]
    window, place, other = (np.ones(len(records), bool) for _ in range(3))
    window[1:] = (records["key"][1:] != records["key"][:-1]) | (records["check"][1:] != records["check"][:-1])
    place[1:] = window[1:] | (records["doc"][1:] != records["doc"][:-1]) | (records["start"][1:] != records["start"][:-1])
    other[1:] = place[1:] | (records["row"][1:] != records["row"][:-1])
    places = np.cumsum(place)
    first = places == places[np.maximum.accumulate(np.where(window, np.arange(len(records)), 0))] if len(records) else window
    return records[other], first[other]


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept (the kept words joined by one space)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed_rows(docs, id_col, text_col)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies, heads = split_copies(rows, "window")
    cuts = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    number = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    hashes = materialise(anchor_hashes(heads.withColumn("batch", number.cast("int")), buckets, window, anchor), "window_hashes")
    index, repeated = FingerprintIndex(spark, buckets), None
    for b in range(batches):
        found = index.add(hashes.filter(F.col("batch") == b).select("bucket", "payload"))
        repeated = found if repeated is None else repeated.unionAll(found)
    repeats = A.RepeatFilter(repeated)
    starts = repeated_starts(heads, repeats, buckets, window, anchor)
    gone = materialise(starts.withColumnRenamed("doc", "id"), "window_starts")
    free_shuffles(spark)
    marked = keyed_rows(docs, id_col, text_col, F.col(id_col).alias("own"))
    marked = marked.join(gone, ["id", "row"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "row"], "left").select("own", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            data, offsets = K.utf8(batch.column("text"))
            word_starts, word_ends, word_offsets = K.words(data, offsets)
            lost, total, kept = [], np.diff(word_offsets), []
            raw = data.tobytes()
            for i, (found, copy) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
                n = int(total[i])
                if copy and n >= window:
                    out = np.ones(n, bool)
                elif found and not copy:
                    out = K.cover(np.frombuffer(found, "<i4").astype(np.int64), window, n)
                else:
                    out = np.zeros(n, bool)
                lost.append(int(out.sum()))
                spans = np.arange(word_offsets[i], word_offsets[i + 1])[~out]
                kept.append(b" ".join([raw[a:b] for a, b in zip(word_starts[spans].tolist(), word_ends[spans].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(total.astype(np.int64)), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return marked.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept string")
