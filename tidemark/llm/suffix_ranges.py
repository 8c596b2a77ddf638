"""Substring deduplication by bytes over range-partitioned sorted suffixes.

A byte goes if some LENGTH-byte string that covers it also starts in a document with a smaller id. Such a string has an
anchor (see anchors.py) whose GRAM bytes occur in more than one slice or document, so only suffixes at repeated anchors
are sorted. A suffix is known by its first LENGTH bytes and by the bytes before it that strings with this anchor can
reach. Splitters, the quantiles of a bounded sample of suffix beginnings, cut the order of suffixes into ranges; as they
are compared on fewer leading bytes than an anchor has, suffixes of one anchor are never on two sides of a boundary, and
the last suffix of a range differs from the first of the next in those bytes.

A range is sorted by multikey quicksort with eight bytes as a symbol: order by the first symbol, then each run of equal
symbols by the next. Strings that start o bytes before their anchors are equal if their suffixes share LENGTH - o bytes
(neighbours in the order) and the o bytes before them have equal hashes; the smallest id of such a group keeps its string.

A slice of the input sends one suffix per content with its smallest id and answers for the others itself, so a passage
that very many documents share meets in a task once per slice.

Defined cases: null and empty texts have no bytes; documents with equal texts are copies of the one with the smallest id
and lose all bytes if they have LENGTH or more; a null id counts as the smallest; rows that repeat an id never remove
each other's bytes, and share one result if their texts are equal; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import anchors as A
from tidemark.llm import textkit as K
from tidemark.llm.exact_dedup import keyed_rows, split_copies
from tidemark.llm.shared import free_shuffles, lean, materialise, small_batches

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
LEADING = 16
#: Suffix beginnings that the splitters are taken from, at the most.
SAMPLE = 20_000
SUFFIX = np.dtype([("text", f"V{REACH + LENGTH}"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i4"), ("low", "u1"), ("high", "u1")])
FOUND = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4")])
RUN = np.dtype([("doc", "<i8"), ("row", "<i8"), ("begin", "<i4"), ("end", "<i4")])


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the GRAM-byte strings inside single texts."""
    doc_end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(data)) + GRAM <= doc_end)
    return at, K.Rolling(data).of(at, at + GRAM)


def _anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, their hashes, and how far before them the first and the last string of each starts."""
    at, hashes = _grams(data, offsets)
    starts, chosen = A.stretches(at, hashes, offsets, LENGTH, GRAM)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(chosen)), bool), chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:], len(chosen))[: len(first)] - 1
    anchors = chosen[first]
    return anchors, hashes[np.searchsorted(at, anchors)], anchors - starts[first], anchors - starts[last]


def repeated_grams(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload) of anchor hashes that occur in more than one document or slice."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            data, offsets = K.utf8(batch.column("text"))
            anchors, hashes, _, _ = _anchored(data, offsets)
            found, counts = K.counted(hashes & ~np.uint64(1))
            yield A.hash_rows(found | (counts > 1).astype(np.uint64), buckets)

    @lean
    def merge(table: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("payload")])
        double = K.distinct(every[every & np.uint64(1) == 1] & ~np.uint64(1))
        hashes, counts = K.counted(every & ~np.uint64(1))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "payload": pa.array([np.union1d(hashes[counts > 1], double).tobytes()], pa.binary())})

    return rows.mapInArrow(run, "bucket int, payload binary").groupBy("bucket").applyInArrow(merge, "bucket int, payload binary")


def _suffixes(batch: pa.RecordBatch, repeats: A.RepeatFilter) -> np.ndarray:
    ids, own = batch.column("id").to_numpy(), batch.column("row").to_numpy()
    data, offsets = K.utf8(batch.column("text"))
    anchors, hashes, high, low = _anchored(data, offsets)
    good = repeats(hashes & ~np.uint64(1))
    anchors, high, low = anchors[good], high[good], low[good]
    doc = np.searchsorted(offsets, anchors, side="right") - 1
    records = np.zeros(len(anchors), SUFFIX)
    if len(anchors):
        # bytes that no string with this anchor reaches are zero, so equal contents look alike
        padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        content = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)[anchors].copy()
        place = np.arange(REACH + LENGTH) - REACH
        content[(place < -high[:, None]) | (place >= LENGTH - low[:, None])] = 0
        records["text"] = content.view(f"V{REACH + LENGTH}").ravel()
        records["doc"], records["row"], records["at"], records["low"], records["high"] = ids[doc], own[doc], anchors - offsets[doc], low, high
    return records


def _symbols(records: np.ndarray, begin: int) -> np.ndarray:
    """The suffixes from byte `begin` of the content on as columns of big-endian 64-bit symbols."""
    raw = np.ascontiguousarray(records["text"]).view(np.uint8).reshape(-1, REACH + LENGTH)[:, begin:]
    wide = np.zeros((len(records), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view(">u8").astype(np.uint64)


def multikey_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the rows: by the first symbol, then runs of equal symbols by the next, and so on."""
    order = np.argsort(symbols[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    for depth in range(symbols.shape[1]):
        column = symbols[order, depth]
        if depth:
            new = np.zeros(len(order), bool)
            new[1:] = group[1:] != group[:-1]
            tied = np.flatnonzero(np.concatenate([new[1:], [True]]) & new)
            open_rows = np.ones(len(order), bool)
            open_rows[tied] = False
            open_rows = np.flatnonzero(open_rows)
            inner = np.lexsort((column[open_rows], group[open_rows]))
            order[open_rows] = order[open_rows[inner]]
            column = symbols[order, depth]
        step = np.zeros(len(order), np.int64)
        step[1:] = (column[1:] != column[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(step)
    return order


def shared_bytes(symbols: np.ndarray) -> np.ndarray:
    """For rows in order: how many leading bytes each has in common with the row before."""
    differ = symbols[1:] ^ symbols[:-1]
    common = np.zeros(len(symbols), np.int64)
    going = np.ones(len(differ), bool)
    for depth in range(symbols.shape[1]):
        x = differ[:, depth]
        high = np.zeros(len(x), np.int64)
        for byte in range(8):
            high += (x >> np.uint64(56 - 8 * byte) == 0) & going
        common[1:] += high
        going &= x == 0
    return common


def repeated_strings(records: np.ndarray) -> np.ndarray:
    """(doc, row, start) of the strings of the suffixes that also occur in a document with a smaller id among them."""
    suffixes = _symbols(records, REACH)
    order = multikey_order(suffixes)
    records, common = records[order], shared_bytes(suffixes[order])
    twin = common >= GRAM
    alive = twin | np.append(twin[1:], False)[: len(twin)]
    records, common = records[alive], common[alive]
    raw = np.ascontiguousarray(records["text"]).view(np.uint8).reshape(-1, REACH + LENGTH)
    before = np.zeros(len(records), np.uint64)
    found = []
    for back in range(REACH + 1):
        if back:
            before = K.mix(before + raw[:, REACH - back].astype(np.uint64) + np.uint64(1))
        same_suffix = np.cumsum(common < LENGTH - back)
        rows = np.flatnonzero((records["low"] <= back) & (back <= records["high"]))
        if not len(rows):
            continue
        doc = records["doc"][rows]
        inner = np.lexsort((doc, before[rows], same_suffix[rows]))
        rows, doc = rows[inner], doc[inner]
        head = np.ones(len(rows), bool)
        head[1:] = (same_suffix[rows][1:] != same_suffix[rows][:-1]) | (before[rows][1:] != before[rows][:-1])
        least = doc[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
        again = rows[doc > least]
        out = np.empty(len(again), FOUND)
        out["doc"], out["row"], out["start"] = records["doc"][again], records["row"][again], records["at"][again] - back
        found.append(out)
    return np.concatenate(found) if found else np.empty(0, FOUND)


def _local(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One record per content with its smallest document, and the strings of the others that it answers."""
    content = _symbols(records, 0)
    order = multikey_order(np.column_stack([content, records["doc"].view(np.uint64) ^ np.uint64(1 << 63)]))
    records, content = records[order], content[order]
    head = np.ones(len(records), bool)
    head[1:] = (content[1:] != content[:-1]).any(axis=1) | (records["low"][1:] != records["low"][:-1]) | (records["high"][1:] != records["high"][:-1])
    least = records["doc"][np.maximum.accumulate(np.where(head, np.arange(len(records)), 0))] if len(records) else records["doc"]
    rest = records[~head & (records["doc"] > least)]
    counts = rest["high"].astype(np.int64) - rest["low"] + 1
    out = np.empty(int(counts.sum()), FOUND)
    out["doc"], out["row"] = np.repeat(rest["doc"], counts), np.repeat(rest["row"], counts)
    out["start"] = np.repeat(rest["at"] - rest["high"].astype(np.int64), counts) + np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)
    # of the same document twice the one is as good as the other for others, but both may be removed
    return records[head | (records["doc"] == least)], out


def _runs(found: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes that the found strings cover."""
    found = found[np.lexsort((found["start"], found["row"], found["doc"]))]
    start = found["start"].astype(np.int64)
    new = np.ones(len(found), bool)
    new[1:] = (found["doc"][1:] != found["doc"][:-1]) | (found["row"][1:] != found["row"][:-1]) | (start[1:] > start[:-1] + LENGTH)
    first = np.flatnonzero(new)
    out = np.empty(len(first), RUN)
    out["doc"], out["row"], out["begin"] = found["doc"][first], found["row"][first], start[first]
    out["end"] = start[np.append(first[1:], len(found))[: len(first)] - 1] + LENGTH
    return out


def removed_runs(rows: DataFrame, buckets: int) -> DataFrame:
    """(doc, row, begins, ends) of removed runs, one row per document; rows: id, row, text, where equal texts have one id."""
    repeats = A.RepeatFilter(materialise(repeated_grams(rows, buckets), "repeated_grams"))

    # the sample: the beginnings of the suffixes with the smallest hashes, from all slices
    @lean
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            data, offsets = K.utf8(batch.column("text"))
            anchors, hashes, _, _ = _anchored(data, offsets)
            good = np.flatnonzero(repeats(hashes & ~np.uint64(1)))
            few = good[np.argsort(hashes[good], kind="stable")[:16]]
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(hashes[few].view(np.int64)), pa.array([raw[a : a + LEADING] for a in anchors[few].tolist()], pa.binary())], names=["h", "lead"])

    leads = sorted(r.lead for r in rows.mapInArrow(sample, "h long, lead binary").orderBy("h", "lead").limit(SAMPLE).collect())
    cuts = [bytes(leads[i * len(leads) // buckets]) for i in range(1, buckets)] if leads else []
    splitters = np.array(sorted(set(cuts)), f"S{LEADING}") if cuts else np.empty(0, f"S{LEADING}")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            records, found = _local(_suffixes(batch, repeats))
            if len(records):
                raw = np.ascontiguousarray(records["text"]).view(np.uint8).reshape(-1, REACH + LENGTH)
                lead = np.ascontiguousarray(raw[:, REACH : REACH + LEADING]).view(f"S{LEADING}").ravel()
                bucket = np.searchsorted(splitters, lead, side="right").astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                used, at = np.unique(bucket[order], return_index=True)
                parts = [x.tobytes() for x in np.split(records[order], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "payload"])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([-1 - int(found["doc"][0] % buckets)], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["bucket", "payload"])

    @lean
    def judge(table: pa.Table) -> pa.Table:
        kind = SUFFIX if table.column("bucket")[0].as_py() >= 0 else FOUND
        records = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("payload")])
        return pa.Table.from_batches([A.rows_by_doc(_runs(repeated_strings(records) if kind is SUFFIX else records), buckets)])

    @lean
    def gather(table: pa.Table) -> pa.Table:
        runs = np.concatenate([np.frombuffer(x.as_buffer(), RUN) for x in table.column("payload")])
        order, head = K.run_ranks(runs["row"], runs["doc"])
        runs, at = runs[order], np.flatnonzero(head)
        parts = np.split(runs, at[1:]) if len(at) else []
        return pa.table({"doc": runs["doc"][at], "row": runs["row"][at]} | {f"{c}s": pa.array([x[c].tobytes() for x in parts], pa.binary()) for c in ("begin", "end")})

    packed = rows.mapInArrow(run, "bucket int, payload binary").groupBy("bucket").applyInArrow(judge, "part int, payload binary")
    return packed.groupBy("part").applyInArrow(gather, "doc long, row long, begins binary, ends binary")


def _merged(begins: bytes, ends: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what the given runs cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.frombuffer(begins, "<i4"), 1)
    np.add.at(change, np.frombuffer(ends, "<i4"), -1)
    inside = np.concatenate([[0], np.cumsum(change[:n]) > 0, [0]]).astype(np.int8)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept binary (what remains need not be valid UTF-8)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed_rows(docs, id_col, text_col)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies, heads = split_copies(rows, "byte")
    gone = materialise(removed_runs(heads, buckets).withColumnRenamed("doc", "id"), "byte_runs")
    free_shuffles(spark)
    marked = keyed_rows(docs, id_col, text_col, F.col(id_col).alias("own"))
    marked = marked.join(gone, ["id", "row"], "left").join(copies.withColumn("copy", F.lit(True)), ["id", "row"], "left").select("own", "text", "begins", "ends", F.coalesce("copy", F.lit(False)).alias("copy"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            data, offsets = K.utf8(batch.column("text"))
            raw, out = data.tobytes(), {"n": [], "lost": [], "spans": [], "kept": []}
            columns = (batch.column(c).to_pylist() for c in ("begins", "ends", "copy"))
            for begin, end, begins, ends, copy in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *columns, strict=True):
                text = raw[begin:end]
                if copy and len(text) >= LENGTH:
                    a, b = np.array([0]), np.array([len(text)])
                elif begins and not copy:
                    a, b = _merged(begins, ends, len(text))
                else:
                    a = b = np.empty(0, np.int64)
                out["n"].append(len(text))
                out["lost"].append(int((b - a).sum()))
                out["spans"].append(len(a))
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(text)]
                out["kept"].append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(out[k], pa.int64()) for k in ("n", "lost", "spans")), pa.array(out["kept"], pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
