"""Candidate pairs from packed posting lists.

A posting is a numpy record of a key, a node and what a caller adds (a size, a component). Postings travel as binary
rows of one bucket each, so that a bucket with a million of them is sorted by numpy instead of being a million rows.
Keys that too many nodes share must not come here; callers send them another way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.shared import lean

#: Of pairs of records: how many common lists a candidate needs, 0 if it can be none.
Need = Callable[[np.ndarray, np.ndarray], np.ndarray]
PER_BUCKET = 100_000


def by_bucket(records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, payload) of the records, by their keys."""
    bucket = ((records["key"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    used, starts = np.unique(bucket, return_index=True)
    parts = [x.tobytes() for x in np.split(records, starts[1:])] if len(used) else []
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "payload"])


def bucket_count(records: int, least: int) -> int:
    return max(least, -(-records // PER_BUCKET))


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each row, count numbers."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _lists(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records by key and node, and which of them are the first of their key."""
    r = r[np.lexsort((r["node"], r["key"]))]
    first = np.ones(len(r), bool)
    first[1:] = r["key"][1:] != r["key"][:-1]
    return r, first


def star_pairs(r: np.ndarray, need: Need) -> np.ndarray:
    """(a, b, lists, need): each node of a key with the key's smallest node; (node, node, keys, 0): how many keys the node shares."""
    r, first = _lists(r)
    lead = r[np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))]
    alone = first & np.append(first[1:], True)[: len(r)]
    nodes, shared = np.unique(r["node"][~alone], return_counts=True)
    return np.concatenate([_counted([_pairs(lead, r, need)]), np.column_stack([nodes, nodes, shared, np.zeros_like(nodes)])])


def cross_pairs(r: np.ndarray, need: Need, block: int = 250_000) -> np.ndarray:
    """(a, b, lists, need): all pairs of a key's nodes that are in different components, built in blocks."""
    r, first = _lists(r)
    if not len(r):
        return np.empty((0, 4), np.int64)
    group = np.cumsum(first) - 1
    later = np.bincount(group)[group] - (np.arange(len(r)) - np.flatnonzero(first)[group]) - 1
    found, at = [], 0
    ends = np.cumsum(later)
    while at < len(r):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
        rows = np.arange(at, min(to, len(r)))
        left = np.repeat(rows, later[rows])
        right = _expand(rows + 1, later[rows])
        differ = r["comp"][left] != r["comp"][right]
        found.append(_pairs(r[left[differ]], r[right[differ]], need))
        at = to
    return _counted(found)


def _pairs(a: np.ndarray, b: np.ndarray, need: Need) -> np.ndarray:
    least = need(a, b)
    keep = (a["node"] != b["node"]) & (least > 0)
    a, b = a["node"][keep], b["node"][keep]
    return np.column_stack([np.minimum(a, b), np.maximum(a, b), least[keep]])


def _counted(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct (a, b, need) as (a, b, times, need)."""
    pairs = np.concatenate(parts)
    order, first = _order(pairs)
    starts = np.flatnonzero(first)
    return np.column_stack([pairs[order][starts, :2], np.diff(np.append(starts, len(pairs))), pairs[order][starts, 2]])


def _order(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    first = np.ones(len(order), bool)
    first[1:] = (pairs[order][1:, :2] != pairs[order][:-1, :2]).any(axis=1)
    return order, first


def candidate_pairs(postings: DataFrame, need: Need, cross: bool, kind: np.dtype) -> DataFrame:
    """(bucket, payload) rows to distinct (a, b, lists, need); buckets below 0 hold pairs made before, as (a, b, need) of 64-bit integers."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        payload = [x.as_buffer() for x in table.column("payload")]
        if table.column("bucket")[0].as_py() < 0:
            pairs = _counted([np.frombuffer(x, "<i8").reshape(-1, 3) for x in payload])
        else:
            records = np.concatenate([np.frombuffer(x, kind) for x in payload])
            keys, counts = K.counted(records["key"])
            shared = keys[counts > 1]
            at = np.minimum(np.searchsorted(shared, records["key"]), max(len(shared) - 1, 0))
            records = records[shared[at] == records["key"]] if len(shared) else records[:0]
            pairs = (cross_pairs if cross else star_pairs)(records, need)
        return pa.table({name: pairs[:, i] for i, name in enumerate(("a", "b", "lists", "need"))})

    found = postings.groupBy("bucket").applyInArrow(run, "a long, b long, lists long, need long")
    return summed(found)


def summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.min("need").alias("need"))


def posting_rows(df: DataFrame, records_of: Callable[[pa.RecordBatch], np.ndarray], buckets: int) -> DataFrame:
    """(bucket, payload) rows of the records that each batch of df makes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                yield by_bucket(records_of(batch.slice(start, 2048)), buckets)

    return df.mapInArrow(run, "bucket int, payload binary")


#: Bits of an id filter; its size is fixed, so it may always be sent to all tasks. With very many ids it lets all rows pass.
FILTER_BITS = 1 << 25


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mixed = K.mix(ids.view(np.uint64))
    return (mixed & np.uint64(FILTER_BITS - 1)).astype(np.int64), (mixed >> np.uint64(39)).astype(np.int64)


class IdFilter:
    """A bit filter of ids, as broadcast words."""

    def __init__(self, ids: DataFrame, column: str):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.concatenate(_bits(batch.column(0).to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], names=["word", "bits"])

        found = ids.select(F.col(column).cast("long")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(FILTER_BITS // 64, np.int64)
        words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        self.held = ids.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """False only for ids that are not in the set."""
        passed = np.ones(len(ids), bool)
        for bit in _bits(np.ascontiguousarray(ids)):
            passed &= (self.held.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        return passed


def _filtered(rows: DataFrame, ids: DataFrame, column: str, keep: bool) -> DataFrame:
    passes = IdFilter(ids, column)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(column).to_numpy()) == keep))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def probably_in(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is in ids, and a few more, before a join that would move whole texts."""
    return _filtered(rows, ids, column, True)


def split(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is certainly not in ids, and the others, of which a few may not be either."""
    return _filtered(rows, ids, column, False), _filtered(rows, ids, column, True)


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is not in ids; only those that the bit filter cannot tell are joined."""
    sure, open_rows = split(rows, ids, column)
    return sure.unionAll(open_rows.join(ids.select(column), column, "left_anti").select(*rows.columns))
