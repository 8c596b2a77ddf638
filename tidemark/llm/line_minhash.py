"""Fuzzy line deduplication: MinHash, banding, exact verification, components.

A line is what stands between newlines, without white space at its ends. Lines without a word are never removed. Equal
lines are one node, known by a 128-bit content hash (its first half numbers the node, the second half checks it). A
node's shingles are SHINGLE consecutive characters (a shorter line is one shingle). Its signature has ROWS * BANDS
values of one of two kinds: one hash function per value (few shingles), or one function whose values are dealt to as
many bins, empty bins taking their left neighbour's value (many). How many bins a shingle set fills decides on the
kinds, between MANY and FEW a node has both, so similar nodes have a kind in common. At the least similarity of 0.8 a
pair shares a band with a probability of 0.99, dissimilar lines hardly ever; `tests/llm` measures it for either kind.

Candidates are verified in two rounds, by the exact Jaccard similarity of the shingle sets. First each node meets one
other: of the smallest nodes of its bands (first within a slice of the input, then over all) the one with which it shares
most bands. Then come the bands whose nodes are still in different components: a band's lines meet in one task, which
counts all overlaps by matrix products over the shingles that two of them share and returns only the links that join
components. Many lines are cut into blocks that meet each other, so no task holds more than BLOCK lines or HELD shingles
and no pair is ever a row. Of a component the occurrence with the smallest (id, row, line number) stays.

A slice of the input sends each band and each line once, with its smallest place; later places of a line are gone
already there, so a line that very many documents hold meets in one task once a slice.

Defined cases: null and empty texts have one line without a word and stay as they are; a null id counts as the smallest;
rows that repeat an id are documents of their own, ordered by a hash of their text; rows repeating both id and text are
one document and share one result; an empty table gives an empty result; other columns, whatever their names, pass
through, but for n_lines and n_removed, which the operator's own replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import postings as P
from tidemark.llm import textkit as K
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import row_key
from tidemark.llm.shared import drop, free_shuffles, lean, materialise, small_batches

SHINGLE, PERCENT = 5, 80
ROWS, BANDS = 7, 20
SIZE = ROWS * BANDS
#: Of SIZE bins: nodes that fill FEW at the most have signatures of the first kind, those that fill MANY at least of the second.
FEW, MANY = 80, 50
#: Lines and shingles of a block.
BLOCK, HELD = 2048, 2_000_000
#: Postings of a bucket, about.
PER_BUCKET = 1_000_000
#: more: whether other nodes of the band, or other places of the line, stayed in the slice
BAND = np.dtype([("key", "<u8"), ("node", "<i8"), ("more", "u1")])
PLACE = np.dtype([("key", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("line", "<i4")])
VOTE = np.dtype([("row", "<i8"), ("lead", "<i8")])
GONE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("line", "<i4")])
MEMBER = np.dtype([("key", "<u8"), ("node", "<i8"), ("comp", "<i8"), ("best", "<i8"), ("n", "<u4")])
MEETING = np.dtype([("row", "<i8"), ("chief", "<i8"), ("own", "u1"), ("n", "<i8")])
#: Characters, and shingles, that are worked on at once: their arrays stay in a core's cache.
NEAR, CLOSE = 1 << 15, 1 << 16
_NONE = np.uint32(2**32 - 1)
_CHARS = np.random.default_rng(31).integers(1, 2**31, (2, SHINGLE), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TURNS = np.random.default_rng(23).integers(1, 2**31, (2, SIZE), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_JOIN = np.random.default_rng(29).integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VOTES, _GONE, _FIRSTS = range(3)


def stripped_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, line number, start and end of the lines that have a word."""
    starts, ends, line_offsets = K.lines(data, offsets)
    doc = K.doc_of(line_offsets)
    number = np.arange(len(starts)) - line_offsets[doc]
    for _ in range(8):  # long margins are rare
        open_rows = np.flatnonzero(starts < ends)
        at_start = open_rows[K.SPACES[data[starts[open_rows]]]]
        starts[at_start] += 1
        open_rows = np.flatnonzero(starts < ends)
        at_end = open_rows[K.SPACES[data[ends[open_rows] - 1]]]
        ends[at_end] -= 1
        if not len(at_start) and not len(at_end):
            break
    else:
        word_starts, word_ends, _ = K.words(data, offsets)
        a, b = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
        has = b > a
        return doc[has], number[has], word_starts[a[has]], word_ends[b[has] - 1]
    has = starts < ends
    return doc[has], number[has], starts[has], ends[has]


def content_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the 128-bit hashes of byte ranges: node numbers and checks."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(found[:, 0]).view(np.int64), np.ascontiguousarray(found[:, 1])


def characters(data: np.ndarray, *places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code points of UTF-8 bytes, and byte places as places among them; of bytes that are not UTF-8 each counts as one."""
    if not len(data) or data.max() < 128:
        return data, *places
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        return data, *places
    before = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(data.view(np.int8) > -65, out=before[1:])
    return points, *[before[x].astype(np.int64) for x in places]


def _spread(points: np.ndarray) -> np.ndarray:
    spread = points.astype(np.uint32)
    spread *= np.uint32(0x9E3779B1)
    spread ^= spread >> np.uint32(15)
    spread *= np.uint32(0x85EBCA77)
    spread ^= spread >> np.uint32(13)
    return spread


def _windows(points: np.ndarray, turns: int) -> list[np.ndarray]:
    """Hashes of the SHINGLE characters from each place on, of each turn; places without so many, and the end, have 0."""
    found = [np.zeros(len(points) + 1, np.uint32) for _ in range(turns)]
    last = len(points) - SHINGLE + 1
    for a in range(0, last, NEAR):
        b = min(a + NEAR, last)
        spread = _spread(points[a : b + SHINGLE - 1])
        part = np.empty(b - a, np.uint32)
        for turn, out in enumerate(found):
            whole = out[a:b]
            for i in range(SHINGLE):
                whole += np.multiply(spread[i : i + b - a], _CHARS[turn, i], out=part)
            whole ^= np.right_shift(whole, np.uint32(16), out=part)
            whole *= np.uint32(0xC2B2AE3D)
    return found


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (of 64 bits, or 32) of the shingles of each byte range, end to end, and n + 1 offsets."""
    points, starts, ends = characters(data, starts, ends)
    n = ends - starts - SHINGLE + 1
    short = np.flatnonzero(n < 1)
    n = np.maximum(n, 1)
    offsets = np.concatenate([[0], np.cumsum(n)])
    places = list(zip(starts.tolist(), (starts + n).tolist(), strict=True))
    found = []
    for turn, whole in enumerate(_windows(points, 1 + wide)):
        hashes = np.concatenate([whole[:0], *[whole[a:b] for a, b in places]])
        for k in short.tolist():  # lines of fewer characters are rare
            value = int(ends[k] - starts[k])
            for x in _spread(points[starts[k] : ends[k]]).tolist():
                value = (value * 0x27D4EB2F + x * int(_CHARS[turn, 0]) + 1) & 0xFFFFFFFF
            hashes[offsets[k]] = value
        found.append(hashes)
    if not wide:
        return found[0], offsets
    both = found[0].astype(np.uint64)
    both <<= np.uint64(32)
    both |= found[1]
    return both, offsets


def _fill(values: np.ndarray) -> np.ndarray:
    """How many of each row's SIZE bins are filled; an empty bin gets what the next filled one to its left has, round the corner, changed by the distance."""
    values = values.reshape(-1)
    full = values != _NONE
    filled, empty = np.flatnonzero(full), np.flatnonzero(~full)
    ends = np.searchsorted(filled, np.arange(0, len(values) + 1, SIZE))
    begin, ends = ends[:-1], ends[1:]
    if len(filled) and len(empty):
        row = empty // SIZE
        before = empty - np.arange(len(empty))
        round_corner = before == begin[row]
        left = filled[np.where(round_corner, ends[row], before) - 1]
        gap = empty - left + np.where(round_corner, SIZE, 0)
        values[empty] = values[left] + gap.astype(np.uint32) * np.uint32(0x9E3779B9)
    return ends - begin


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, kind (0: a function per value, 1: bins) and SIZE signature values of each row and kind that it has."""
    n = np.diff(offsets)
    if hashes.dtype == np.uint64:
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    many = np.flatnonzero(n >= MANY)
    some = hashes if len(many) == len(n) else hashes[np.repeat(n >= MANY, n)]
    values = np.full((len(many), SIZE), _NONE)
    bins = np.zeros(len(n), np.int64)
    cuts = np.concatenate([[0], np.cumsum(n[many])])
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + CLOSE, side="right")) - 1)
        inside = some[cuts[at] : cuts[to]]
        place = inside >> np.uint32(16)
        place *= np.uint32(SIZE)
        place >>= np.uint32(16)
        place = place + np.repeat(np.arange(to - at) * SIZE, n[many[at:to]])
        np.minimum.at(values[at:to].reshape(-1), place, inside)
        bins[many[at:to]] = _fill(values[at:to])
        at = to
    both = bins[many] >= MANY
    if not both.all():
        many, values = many[both], values[both]
    few = np.flatnonzero(bins <= FEW)
    inside = hashes[np.repeat(bins <= FEW, n)]
    cuts = np.concatenate([[0], np.cumsum(n[few])])[:-1]
    least = np.empty((SIZE, len(few)), np.uint32)
    turned = np.empty_like(inside)
    for i in range(SIZE if len(few) else 0):
        np.multiply(inside, _TURNS[0, i], out=turned)
        turned += _TURNS[1, i]
        np.minimum.reduceat(turned, cuts, out=least[i])
    least = least.T
    return np.append(few, many), np.append(np.zeros(len(few), np.int64), np.ones(len(many), np.int64)), np.concatenate([least, values])


def bands(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and band keys, BANDS for each row and kind."""
    row, kind, values = signatures(hashes, offsets)
    values = values.reshape(-1, BANDS, ROWS)
    joined = np.zeros(values.shape[:2], np.uint64)
    for i in range(ROWS):
        joined += values[:, :, i].astype(np.uint64) * _JOIN[i]
    salt = K.mix((np.arange(BANDS) + kind[:, None] * BANDS).astype(np.uint64) + np.uint64(1))
    return np.repeat(row, BANDS), K.mix(joined + salt).reshape(-1)


def _by_key(keys: np.ndarray) -> np.ndarray:
    """Stable order of the keys (of equal leading bits only, which a band's second lead does no harm to)."""
    if len(keys) >= 1 << 24:
        return np.argsort(keys, kind="stable")
    return (np.sort((keys & ~np.uint64(2**24 - 1)) | np.arange(len(keys), dtype=np.uint64)) & np.uint64(2**24 - 1)).astype(np.int64)


def _heads(x: np.ndarray) -> np.ndarray:
    head = np.ones(len(x), bool)
    head[1:] = x[1:] != x[:-1]
    return head


def _packed(records: np.ndarray, buckets: int, first: int = 0) -> pa.RecordBatch:
    batch = P.by_bucket(records, buckets)
    return batch if not first else batch.set_column(0, "bucket", pa.array(batch.column(0).to_numpy() + np.int32(first)))


def _ranged(columns: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """(bucket, payload) rows, column after column, by ranges of the key, which comes first and is in order of its leading bits."""
    bucket = (columns[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    begin = np.flatnonzero(_heads(bucket))
    cuts = np.append(begin, len(bucket)).tolist()
    payload = [b"".join(x[a:b].tobytes() for x in columns) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array(payload, pa.binary())], names=["bucket", "payload"])


def _columns(payloads: pa.ChunkedArray, kind: np.dtype) -> list[np.ndarray]:
    """The columns that _ranged packed, of all payloads."""
    found = [[] for _ in kind.names]
    for x in payloads:
        x, at = x.as_buffer(), 0
        n = x.size // kind.itemsize
        for column, name in zip(found, kind.names, strict=True):
            column.append(np.frombuffer(x, kind[name], n, at))
            at += n * kind[name].itemsize
    return [np.concatenate(x) for x in found]


def _by_part(records: np.ndarray, parts: int, kind: int) -> pa.RecordBatch:
    """(kind, part, payload) rows; a part is some rows (or nodes)."""
    part = (K.mix(np.ascontiguousarray(records["row"]).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    used, starts = np.unique(part[order], return_index=True)
    payload = [x.tobytes() for x in np.split(records[order], starts[1:])] if len(used) else []
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int32)), pa.array(used, pa.int32()), pa.array(payload, pa.binary())], names=["kind", "part", "payload"])


def _first_places(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places (key: node, check, doc, row, line) the smallest of each line, and all others; equal places are one."""
    records = records[np.lexsort((records["line"], records["row"], records["doc"], records["check"], records["key"]))]
    line, place = np.ones(len(records), bool), np.ones(len(records), bool)
    line[1:] = (records["key"][1:] != records["key"][:-1]) | (records["check"][1:] != records["check"][:-1])
    place[1:] = line[1:] | (records["doc"][1:] != records["doc"][:-1]) | (records["row"][1:] != records["row"][:-1]) | (records["line"][1:] != records["line"][:-1])
    return records[line], records[place & ~line]


def _gone(places: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), GONE)
    for c in GONE.names:
        out[c] = places[c]
    return out


def posted(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload): bands below `buckets`, places of lines below twice that; below 0 votes and gone places that a slice knows."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, most=1 << 20):
            data, offsets = K.utf8(batch.column("text"))
            doc, number, starts, ends = stripped_lines(data, offsets)
            nodes, checks = content_hashes(data, starts, ends)
            places = np.empty(len(nodes), PLACE)
            places["key"], places["check"], places["line"] = nodes.view(np.uint64), checks, number
            places["doc"], places["row"] = batch.column("id").to_numpy()[doc], batch.column("row").to_numpy()[doc]
            first, later = _first_places(places)
            yield _packed(first, buckets, buckets)
            distinct, at = np.unique(nodes, return_index=True)
            line, keys = bands(*shingles(data, starts[at], ends[at], wide=False))
            line = line[::BANDS]
            order = np.argsort(line, kind="stable")
            line, keys = line[order], keys.reshape(-1, BANDS)[order].reshape(-1)
            order = _by_key(keys)
            keys, owner = keys[order], distinct[line[order // BANDS]]
            head = _heads(keys)
            begin = np.flatnonzero(head)
            members = np.diff(np.append(begin, len(keys)))
            yield _ranged([keys[begin], owner[begin], (members > 1).astype(np.uint8)], buckets)
            votes = np.empty(len(keys) - len(begin), VOTE)
            votes["lead"], votes["row"] = owner[np.repeat(begin, members)[~head]], owner[~head]
            for kind, rest in ((_VOTES, votes), (_GONE, _gone(later))):
                if len(rest):
                    bucket = -1 - kind - 2 * int(rest["row"][0] % buckets)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([rest.tobytes()], pa.binary())], names=["bucket", "payload"])

    return rows.mapInArrow(run, "bucket int, payload binary")


def judged(postings: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(kind, part, payload): votes (row: a node, lead: the smallest of one of its bands), gone places, first places of lines."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if 0 <= bucket < buckets:
            return pa.Table.from_batches([_by_part(led(*_columns(table.column("payload"), BAND)), parts, _VOTES)])
        known = PLACE if bucket >= 0 else (VOTE, GONE)[(-1 - bucket) % 2]
        r = np.concatenate([np.frombuffer(x.as_buffer(), known) for x in table.column("payload")])
        if bucket < 0:
            return pa.Table.from_batches([_by_part(r, parts, (-1 - bucket) % 2)])
        first, later = _first_places(r)
        out = np.empty(len(first), [("row", "<i8"), *PLACE.descr[1:3], ("own", "<i8"), ("line", "<i4")])
        out["row"], out["check"], out["doc"], out["own"], out["line"] = first["key"].view(np.int64), first["check"], first["doc"], first["row"], first["line"]
        return pa.Table.from_batches([_by_part(_gone(later), parts, _GONE), _by_part(out, parts, _FIRSTS)])

    def led(key: np.ndarray, node: np.ndarray, more: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        head = _heads(key[order])
        alone = head & np.append(head[1:], True)[: len(head)] & (more[order] == 0)
        node, begin = node[order[~alone]], np.flatnonzero(head[~alone])
        votes = np.empty(len(node), VOTE)
        lead = np.minimum.reduceat(node, begin) if len(begin) else node
        votes["row"], votes["lead"] = node, np.repeat(lead, np.diff(np.append(begin, len(node))))
        return votes

    return postings.groupBy("bucket").applyInArrow(run, "kind int, part int, payload binary")


def best_leads(votes: DataFrame) -> DataFrame:
    """(node, best): of every node that shares a band the node with most votes, null if all votes are for itself."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x.as_buffer(), VOTE) for x in table.column("payload")])
        nodes = K.distinct(r["row"])
        r = r[r["row"] != r["lead"]]
        r = r[np.lexsort((r["lead"], r["row"]))]
        begin = np.flatnonzero(_heads(r["row"]) | _heads(r["lead"]))
        count = np.diff(np.append(begin, len(r)))
        node, lead = r["row"][begin], r["lead"][begin]
        order = np.lexsort((lead, -count, node))
        node, lead = node[order], lead[order]
        head = _heads(node)
        node, lead = node[head], lead[head]
        best, has = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
        at = np.searchsorted(nodes, node)
        best[at], has[at] = lead, True
        return pa.table({"node": nodes, "best": pa.array(best, mask=~has)})

    # a node that is only ever a lead has no votes of its own row if its bands' others stayed in slices
    leads = votes.mapInArrow(_lead_rows, "part int, payload binary")
    return votes.select("part", "payload").unionAll(leads).groupBy("part").applyInArrow(run, "node long, best long").groupBy("node").agg(F.max("best").alias("best"))


def _lead_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leads = [K.distinct(np.frombuffer(x.as_buffer(), VOTE)["lead"]) for x in batch.column("payload")]
        payload = []
        for x in leads:
            own = np.empty(len(x), VOTE)
            own["row"] = own["lead"] = x
            payload.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(payload, pa.binary())], names=["part", "payload"])


def line_texts(rows: DataFrame, best: DataFrame) -> DataFrame:
    """(node, check, line, best) of the nodes of best, one row each."""
    passes = P.IdFilter(best, "node")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, most=1 << 20):
            data, offsets = K.utf8(batch.column("text"))
            _, _, starts, ends = stripped_lines(data, offsets)
            nodes, checks = content_hashes(data, starts, ends)
            found, first = np.unique(nodes, return_index=True)
            good = passes(found)
            found, first = found[good], first[good]
            raw = data.tobytes()
            text = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(checks[first].view(np.int64)), pa.array(text, pa.binary()).cast(pa.string())], names=["node", "check", "line"])

    every = rows.select("text").mapInArrow(run, "node long, check long, line string")
    return every.groupBy("node").agg(F.min(F.struct("check", "line")).alias("x")).select("node", "x.check", "x.line").join(best, "node").select("node", "check", "line", "best")


def overlaps(hashes: np.ndarray, cuts: np.ndarray, percent: int, width: int = 4096) -> np.ndarray:
    """Which pairs of rows have shingle sets of the similarity, as a square matrix; counted over shingles of two rows or more."""
    n = len(cuts) - 1
    low = np.uint64(max(1, int(n).bit_length()))
    found = K.distinct((hashes >> low << low) | K.doc_of(cuts).astype(np.uint64))
    row, shingle = (found & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), found >> low
    sizes = np.bincount(row, minlength=n)
    head = _heads(shingle)
    alone = head & np.append(head[1:], True)[: len(head)]
    row, head = row[~alone], head[~alone]
    column = np.cumsum(head) - 1
    common = np.zeros((n, n), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + width, width))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            seen = np.zeros((n, int(column[b - 1] - column[a]) + 1), np.float32)
            seen[row[a:b], column[a:b] - column[a]] = 1
            common += seen @ seen.T
    return (100 + percent) * common >= percent * (sizes[:, None] + sizes[None, :]).astype(np.float32) - np.float32(0.5)


def verified(lines: DataFrame, percent: int) -> DataFrame:
    """(a, b): each line (b) with its best lead (a), where their shingle sets reach the similarity; rows: node, line, best."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(iter([whole]), text="la", most=1 << 18, rows=4096):
                n = batch.num_rows
                data, offsets = K.utf8(pa.concat_arrays([batch.column("la"), batch.column("lb")]))
                good = similar(*shingles(data, offsets[:-1], offsets[1:]), np.arange(n), np.arange(n, 2 * n), percent)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    led = lines.filter("best is not null").select(F.col("best").alias("a"), F.col("node").alias("b"), F.col("line").alias("lb"))
    return led.join(lines.select(F.col("node").alias("a"), F.col("line").alias("la")), "a").select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def meetings(placed: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(node, group): the tasks in which a node's line is compared.

    A band with several components belongs to the component most of its nodes are in, and all such bands of a component
    meet in one group: its own nodes there and the others. Own nodes need not meet each other, so beyond BLOCK lines
    or HELD shingles the others' blocks meet each other and the blocks of own nodes.
    """

    @lean
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text="line", most=1 << 20):
            data, offsets = K.utf8(batch.column("line"))
            hashes, cuts = shingles(data, offsets[:-1], offsets[1:], wide=False)
            line, keys = bands(hashes, cuts)
            order = _by_key(keys)
            line = line[order]
            yield _ranged([keys[order], *[batch.column(name).to_numpy()[line] for name in ("node", "comp", "best")], np.diff(cuts).astype(np.uint32)[line]], buckets)

    @lean
    def mixed(table: pa.Table) -> pa.Table:
        key, *rest = _columns(table.column("payload"), MEMBER)
        order = np.argsort(key)
        begin = np.flatnonzero(_heads(key[order]))
        members = np.diff(np.append(begin, len(key)))
        node, comp, best = (x[order] for x in rest[:3])
        several = np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)
        two = np.flatnonzero(members == 2)
        x, y = begin[two], begin[two] + 1
        several[two[(best[x] == node[y]) | (best[y] == node[x])]] = False  # compared in the first round
        order, members = order[np.repeat(several, members)], members[several]
        r = np.empty(len(order), MEMBER)
        for name, x in zip(MEMBER.names, (key, *rest), strict=True):
            r[name] = x[order]
        r = r[np.lexsort((r["comp"], r["key"]))]
        band = np.repeat(np.arange(len(members)), members)
        begin = np.flatnonzero(_heads(band) | _heads(r["comp"]))
        count, of = np.diff(np.append(begin, len(r))), band[begin]
        order = np.lexsort((r["comp"][begin], -count, of))
        chief = r["comp"][begin[order[_heads(of[order])]]]
        out = np.empty(len(r), MEETING)
        out["row"], out["chief"], out["own"], out["n"] = r["node"], chief[band], r["comp"] == chief[band], r["n"]
        return pa.Table.from_batches([_by_part(out, parts, 0)])

    @lean
    def gather(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x.as_buffer(), MEETING) for x in table.column("payload")])
        r = r[np.lexsort((r["chief"], r["row"]))]
        r = r[_heads(r["row"]) | _heads(r["chief"])]
        return pa.table({"node": np.ascontiguousarray(r["row"]), "chief": np.ascontiguousarray(r["chief"]), "own": r["own"] == 1, "n": np.ascontiguousarray(r["n"])})

    found = placed.mapInArrow(post, "bucket int, payload binary").groupBy("bucket").applyInArrow(mixed, "kind int, part int, payload binary")
    met = materialise(found.groupBy("part").applyInArrow(gather, "node long, chief long, own boolean, n long"), "line_meetings")
    blocks = lambda own: F.greatest(F.ceil(F.sum(F.when(own, 1)) / (BLOCK // 2)), F.ceil(F.sum(F.when(own, F.col("n"))) / (HELD // 2)))
    cut = met.groupBy("chief").agg(blocks(F.col("own")).alias("owns"), blocks(~F.col("own")).alias("others"))
    cut = cut.withColumn("owns", F.coalesce("owns", F.lit(0))).filter("owns + others > 2")
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.xxhash64("chief", F.least(block(F.col("others")), j), F.greatest(block(F.col("others")), j))),
        F.when(F.col("owns") > 0, F.transform(F.sequence(F.lit(0), F.col("owns") - 1), lambda k: F.xxhash64("chief", block(F.col("others")), -1 - k))).otherwise(F.array().cast("array<bigint>")),
    )
    own = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.xxhash64("chief", i, -1 - block(F.col("owns"))))
    groups = F.when(F.col("others").isNull(), F.array(F.xxhash64("chief"))).when(F.col("own"), own).otherwise(other)
    return met.join(cut, "chief", "left").select("node", F.explode(groups).alias("group"))


def joining_links(met: DataFrame, percent: int, few: int = 8, held: int = 4096) -> DataFrame:
    """(a, b): links between components; rows of met: group, comp, line.

    The rows of a partition come by group; `few` lines at the most are compared pair by pair, many groups at once.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(x.num_rows for x in waiting) >= held or sum(x.nbytes for x in waiting) >= 4 << 20:
                table = pa.Table.from_batches(waiting)
                group = table.column("group").to_numpy()
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield links(table.slice(0, whole))
                    waiting = table.slice(whole).combine_chunks().to_batches()
        if waiting:
            yield links(pa.Table.from_batches(waiting))

    def links(table: pa.Table) -> pa.RecordBatch:
        data, offsets = K.utf8(table.column("line"))
        hashes, cuts = shingles(data, offsets[:-1], offsets[1:])
        comp = table.column("comp").to_numpy()
        begin = np.flatnonzero(_heads(table.column("group").to_numpy()))
        members = np.diff(np.append(begin, len(comp)))
        pairs = []
        for n in range(2, few + 1):
            at = begin[members == n]
            for i in range(n):
                for j in range(i + 1, n):
                    pairs.append(np.column_stack([at + i, at + j]))
        x, y = np.concatenate([*pairs, np.empty((0, 2), np.int64)]).T
        differ = comp[x] != comp[y]
        x, y = x[differ], y[differ]
        good = np.concatenate([similar(hashes, cuts, x[i : i + 2048], y[i : i + 2048], percent) for i in range(0, len(x), 2048)] + [np.empty(0, bool)])
        found = [np.column_stack([comp[x[good]], comp[y[good]]])]
        for a, n in zip(begin[members > few].tolist(), members[members > few].tolist(), strict=True):
            found.append(spanning(comp[a : a + n], overlaps(hashes[cuts[a] : cuts[a + n]], cuts[a : a + n + 1] - cuts[a], percent)))
        found = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["a", "b"])

    return met.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def similar(hashes: np.ndarray, cuts: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (at most 4,096) of rows of shingles reach the similarity."""
    sets = []
    for side, rows in enumerate((x, y)):
        n = cuts[rows + 1] - cuts[rows]
        if len(rows) and (rows[1:] - rows[:-1] == 1).all():
            inside = hashes[cuts[rows[0]] : cuts[rows[-1] + 1]]
        else:
            inside = hashes[np.arange(n.sum()) + np.repeat(cuts[rows] - np.cumsum(n) + n, n)]
        # the pair in the high bits of the hash, the side in the lowest: one plain sort finds the sets of all pairs
        inside = inside >> np.uint64(12) & ~np.uint64(1)
        inside |= np.repeat((np.arange(len(rows), dtype=np.uint64) << np.uint64(52)) | np.uint64(side), n)
        sets.append(inside)
    both = np.concatenate(sets)
    both.sort()
    both = both[_heads(both)]
    shared = (both[1:] ^ both[:-1]) == 1
    pair = (both >> np.uint64(52)).astype(np.int64)
    common = np.bincount(pair[1:][shared], minlength=len(x))
    union = np.bincount(pair, minlength=len(x)) - common
    return 100 * common >= percent * union


def spanning(comp: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Of all links between rows those that join the rows' components."""
    comps, own = np.unique(comp, return_inverse=True)
    x, y = np.nonzero(good & (own[:, None] < own[None, :]))
    pairs = K.distinct(own[x] * len(comps) + own[y])
    parent, links = list(range(len(comps))), []
    for a, b in zip((pairs // len(comps)).tolist(), (pairs % len(comps)).tolist(), strict=True):
        link = comps[a], comps[b]
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append(link)
    return np.array(links, np.int64).reshape(-1, 2)


def line_components(rows: DataFrame, votes: DataFrame, percent: int, buckets: int, parts: int) -> DataFrame:
    """(node, check, root) of the lines that are similar to another line; rows: text."""
    best = materialise(best_leads(votes), "line_best")
    lines = materialise(line_texts(rows, best), "line_texts")
    free_shuffles(rows.sparkSession)
    links = materialise(verified(lines, percent), "line_links")
    labels = materialise(components(links), "line_labels")
    placed = lines.join(labels, "node", "left").select("node", "line", F.coalesce("root", "node").alias("comp"), F.coalesce("best", "node").alias("best"))
    placed = materialise(placed, "line_placed")
    drop(best, links)
    met = materialise(meetings(placed, buckets, parts), "line_groups").withColumnRenamed("node", "__node")
    free_shuffles(rows.sparkSession)
    more = materialise(joining_links(placed.join(met, F.col("node") == F.col("__node")).select("group", "comp", "line"), percent), "line_joins")
    drop(placed)
    found = components(more.unionAll(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    found = materialise(lines.select("node", "check").join(found, "node"), "line_components")
    drop(lines, more, labels)
    return found


def gone_lines(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, row, gone array<boolean>): by line number whether it goes, for documents that lose any; rows: id, row, text."""
    spark = rows.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = rows.agg(F.sum(F.size(F.split("text", "\n", -1)))).first()[0] or 0
    buckets = max(parts, -(-lines * BANDS // PER_BUCKET))
    found = materialise(judged(posted(rows, buckets), buckets, parts), "line_judged")
    free_shuffles(spark)
    kind = lambda k: found.filter(F.col("kind") == k).select("part", "payload")
    labels = line_components(rows, kind(_VOTES), percent, buckets, parts)
    linked = P.IdFilter(labels, "node")
    first = np.dtype([("node", "<i8"), ("check", "<i8"), ("doc", "<i8"), ("own", "<i8"), ("line", "<i4")])

    @lean
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("payload"):
                r = np.frombuffer(x.as_buffer(), first)
                r = r[linked(r["node"])]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[c])) for c in first.names], names=list(first.names))

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, GONE)
            for c in GONE.names:
                out[c] = batch.column(c).to_numpy()
            yield _by_part(out, parts, _GONE).select(["part", "payload"])

    @lean
    def gather(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x.as_buffer(), GONE) for x in table.column("payload")])
        r = r[np.lexsort((r["line"], r["doc"], r["row"]))]
        begin = np.flatnonzero(_heads(r["row"]) | _heads(r["doc"]))
        ends = np.append(begin[1:], len(r))[: len(begin)]
        sizes = r["line"][ends - 1].astype(np.int64) + 1
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        flags = np.zeros(cuts[-1], bool)
        flags[np.repeat(cuts[:-1], ends - begin) + r["line"]] = True
        return pa.table({"doc": r["doc"][begin], "row": r["row"][begin], "gone": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flags))})

    linked_firsts = kind(_FIRSTS).mapInArrow(firsts, "node long, check long, doc long, own long, line int").join(labels, ["node", "check"])
    linked_firsts = materialise(linked_firsts.select("root", "doc", F.col("own").alias("row"), "line"), "line_firsts")
    stays = linked_firsts.groupBy("root").agg(F.min(F.struct("doc", "row", "line")).alias("stays"))
    lost = linked_firsts.join(stays, "root").filter(F.struct("doc", "row", "line") != F.col("stays")).select("doc", "row", "line")
    every = kind(_GONE).unionAll(lost.mapInArrow(packed, "part int, payload binary"))
    gone = materialise(every.groupBy("part").applyInArrow(gather, "doc long, row long, gone array<boolean>").withColumnRenamed("doc", "id"), "lines_gone")
    drop(found, labels, linked_firsts)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, counts: bool = True) -> DataFrame:
    """The input's rows and columns with the lines removed from the text, and n_lines and n_removed behind them if counts are wanted."""
    small_batches(docs.sparkSession)
    number, row = row_key(F.col(id_col), F.col(text_col))
    gone = gone_lines(docs.select(number.alias("id"), row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), percent)
    whole = docs.select(number.alias("id"), row.alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    whole = whole.join(gone, ["id", "row"], "left").select("doc", "gone")
    text = F.col("doc").getField(text_col)
    left = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    columns = [kept.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if counts:
        columns += [F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size(F.filter("gone", lambda x: x)), F.lit(0)).cast("long").alias("n_removed")]
    return whole.select(*columns)
