"""Anchors: sampled positions that equal stretches of units (bytes or words) sample alike.

Of each stretch of `length` units the leftmost smallest hash of `width` consecutive units inside it is its anchor. Equal
stretches have their anchors at the same place, so a stretch can only occur twice if its anchor's hash does. Anchors are
a fraction of about 2 / (length - width + 2) of all positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.shared import lean

_PLACE = np.uint64((1 << 28) - 1)
#: Bits of the filter of repeated anchors; fixed, so it may be sent to all tasks. When full it lets every anchor pass.
FILTER_BITS = 1 << 27


def stretches(at: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all stretches of `length` units, and the anchor position of each. at, hashes: windows of `width` units; offsets: of each text's units."""
    n = int(offsets[-1])
    if n < length or n >= int(_PLACE):
        if n >= int(_PLACE):
            raise ValueError("a slice of texts may have 2**28 units at the most")
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = np.full(n, np.uint64(2**64 - 1))
    keys[at] = (hashes & ~_PLACE) | at.astype(np.uint64)
    reach, done = length - width + 1, 1
    while done < reach:
        step = min(done, reach - done)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        done += step
    sizes = np.diff(offsets)
    starts = np.arange(len(keys))
    last = np.repeat(offsets[1:], sizes)[: len(keys)]
    starts = starts[starts + length <= last]
    return starts, (keys[starts] & _PLACE).astype(np.int64)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


class RepeatFilter:
    """A broadcast bit filter of hashes; column `payload` of rows has them as 64-bit integers."""

    def __init__(self, rows: DataFrame):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashes = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
                bits = K.distinct(np.concatenate(_bits(hashes)))
                word, start = bits >> 6, np.flatnonzero(np.concatenate([np.ones(min(1, len(bits)), bool), np.diff(bits >> 6) > 0]))
                values = np.bitwise_or.reduceat(np.int64(1) << (bits & 63), start) if len(start) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word[start]), pa.array(values)], names=["word", "bits"])

        words = np.zeros(FILTER_BITS // 64, np.int64)
        found = rows.select("payload").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        for batch in found.toArrow().to_batches():
            words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        self.held = rows.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        passed = np.ones(len(hashes), bool)
        for bit in _bits(hashes):
            passed &= (self.held.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        return passed


def hash_rows(hashes: np.ndarray, buckets: int, extra: dict[str, int] | None = None) -> pa.RecordBatch:
    """Sorted hashes as (bucket, payload) rows; the bucket is a range of hashes."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    used, starts = np.unique(bucket, return_index=True)
    parts = [x.tobytes() for x in np.split(hashes, starts[1:])] if len(used) else []
    more = {k: pa.array(np.full(len(used), v, np.int32)) for k, v in (extra or {}).items()}
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary()), *more.values()], names=["bucket", "payload", *more])


def rows_by_doc(records: np.ndarray, parts: int) -> pa.RecordBatch:
    """Records with a field row as (part, payload) rows, a part being some documents."""
    part = (K.mix(np.ascontiguousarray(records["row"]).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    used, starts = np.unique(part[order], return_index=True)
    payload = [x.tobytes() for x in np.split(records[order], starts[1:])] if len(used) else []
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(payload, pa.binary())], names=["part", "payload"])
