"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are counted over all documents and renamed by rank (most frequent first, ties by id), so frequent ids take one
byte. Of every id a two-bit code (bytes - 1) goes to the document's control bytes, four codes a byte, and its low bytes
go to the data bytes. A control byte's four lengths come from a 256-row table, so decoding is table lookup and gather
over whole batches without a loop over ids.

The files are a Parquet table in ascending order of doc_id (null first): part, position in the part, doc_id, n_tokens,
control, data; beside them stands the table of ranks, so that the folder can be read without anything else. Spark's committer names a part only when its task is done, so a lost executor
leaves no torn file. Parts are numbered in order; a document's start is its part's start plus what its part holds
before it, and only one total per part meets in one task.

Defined cases: null and empty texts hold the end id alone; rows that repeat an id follow each other by a hash
of their ids; bytes that are not UTF-8 count as replacement characters; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.shared import discard, lean, new_path, small_batches
from tidemark.llm.units import Pool, Table

#: Encoded units that a worker keeps; beyond that it starts anew.
CACHED = 2_000_000
JOINED = 500
#: Bytes of a unit that is kept; longer ones are encoded each time.
LONGEST = 64
#: Row c: the lengths in bytes of the four ids that control byte c describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1

#: Fixed value: the pattern of tokenizers that cut a letter or digit from punctuation behind it.
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _MARK, _OPEN = range(5)
FILES = "part int, position long, doc_id long, n_tokens long, control binary, data binary"
_NEVER = np.int32(2**31 - 1)


def _classes() -> np.ndarray:
    """Of bytes: what the pattern makes of them, _OPEN where that needs the tokenizer itself."""
    kinds = np.full(256, _OPEN, np.uint8)
    kinds[33:127] = _MARK
    kinds[[32, *range(9, 14)]] = _SPACE
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = _LETTER
    kinds[39] = _OPEN
    return kinds


_CLASSES = _classes()


class Merges:
    """The merges of a byte-level model with word ends, applied to many words at once: least rank first, then leftmost."""

    def __init__(self, vocab: dict[str, int], merges: list):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = Table()
        self.ranks.add(self._keys(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs])), np.arange(len(pairs), dtype=np.int32))

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return K.mix((left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + np.uint64(1))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks.find(self._keys(left, right), _NEVER)

    def encode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: rows of bytes. The ids of each, filled up with -1, and how many."""
        n, width = words.shape
        out, counts, rows = np.full((n, width), -1, np.int32), np.ones(n, np.int64), np.arange(n)
        symbols = self.inner[words]
        symbols[:, -1] = self.last[words[:, -1]]
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            width = symbols.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                going = best != _NEVER
            else:
                going = np.zeros(len(rows), bool)
            done = ~going
            out[rows[done], :width], counts[rows[done]] = symbols[done], width
            rows = rows[going]
            if not len(rows):
                break
            symbols, ranks, at, best = symbols[going], ranks[going], at[going], best[going]
            each = np.arange(len(rows))
            symbols[each, at] = self.merged[best]
            kept = np.ones(symbols.shape, bool)
            kept[each, at + 1] = False
            symbols = symbols[kept].reshape(len(rows), width - 1)
            kept = np.ones(ranks.shape, bool)
            kept[each, at] = False
            ranks = ranks[kept].reshape(len(rows), width - 2)
            for shift in (-1, 0):
                some = np.flatnonzero((at + shift >= 0) & (at + shift < width - 2))
                place = at[some] + shift
                ranks[some, place] = self.rank(symbols[some, place], symbols[some, place + 1])
        return out, counts


class UnitCache:
    """Ids of texts by units, exact for tokenizers whose pattern never crosses white space.

    Of a tokenizer that composes, lower-cases and has the pattern _APART, words of ASCII and of the letters of Latin-1
    fall into units as the pattern would cut them: runs of letters, single digits, runs of marks. All other words (with
    an apostrophe, other characters, special tokens) are one unit each and go to the tokenizer. Units are known by
    64-bit hashes with their length; a pool keeps their ids.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            steps = json.load(f)
        normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
        patterns = [x.get("pattern", {}).get("Regex") for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        special = [x["content"] for x in steps["added_tokens"]]
        model = steps["model"]
        self.apart = (
            normal == ["NFC", "Replace", "Lowercase"] and patterns[:1] == [_APART] and all(x.startswith("<|") for x in special)
            and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not model["ignore_merges"] and not model["continuing_subword_prefix"]
        )
        self.merges = Merges(model["vocab"], model["merges"]) if self.apart else None
        self.pool = Pool(CACHED)

    def _by_tokenizer(self, words: list[str]) -> np.ndarray:
        """Entries of words without white space, many in one call; a token belongs to the word in whose span it starts."""
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for start in range(0, len(words), JOINED):
            part = words[start : start + JOINED]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            starts = np.array(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            ids.append(np.array(found.ids, np.uint32))
            counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        return self.pool.keep(np.concatenate(ids), np.concatenate(counts))

    def _by_merges(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        entries = np.empty(len(starts), np.int32)
        for size in K.distinct(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            ids, counts = self.merges.encode(data[starts[some][:, None] + np.arange(size)])
            entries[some] = self.pool.keep(ids[ids >= 0].astype(np.uint32), counts)
        return entries

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, whether each is one for the merges, and the bytes with capitals folded."""
        kinds = _CLASSES[data]
        if self.apart:
            folded = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
            lead = np.flatnonzero(data[:-1] == 0xC3)
            follow = data[lead + 1]
            good = (follow != 0x97) & (follow != 0xB7)  # the two that are no letters
            lead, follow = lead[good], follow[good]
            kinds[lead] = kinds[lead + 1] = _LETTER
            folded[lead + 1] = np.where(follow < 0x9F, follow + np.uint8(32), follow)
            kinds[:-1][(data[:-1] == 60) & (data[1:] == 124)] = _OPEN  # special tokens are found in the text as it stands
        else:
            folded = data
        edge = np.ones(len(data), bool)  # of a word
        edge[1:] = kinds[:-1] == _SPACE
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        first = edge & (kinds != _SPACE)
        cut = first.copy()
        if self.apart:
            cut[1:] |= ((kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)) & (kinds[1:] != _SPACE)
        starts = np.flatnonzero(cut)
        is_first = first[starts]
        word = np.cumsum(is_first) - 1
        word_starts = starts[is_first]
        closed = np.ones(len(data) + 1, bool)
        closed[:-1] = (kinds == _SPACE) | edge
        stops = np.flatnonzero(closed)
        word_ends = stops[np.searchsorted(stops, word_starts, side="right")] if len(word_starts) else word_starts
        whole = np.full(len(word_starts), not self.apart)
        whole[np.searchsorted(word_starts, np.flatnonzero(kinds == _OPEN), side="right") - 1] = True
        kept = is_first | ~whole[word]
        starts, word = starts[kept], word[kept]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        ends = np.minimum(ends, word_ends[word])
        return starts, ends, ~whole[word], folded

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and n + 1 offsets."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, ends, cut, folded = self.units(data, offsets)
        # bit 0 tells the units of the merges from words; 0 is no key
        keys = K.Rolling(folded).of(starts, ends) & ~np.uint64(1) | cut.astype(np.uint64) | (~cut).astype(np.uint64) << np.uint64(63)
        odd = np.flatnonzero(ends - starts > LONGEST)
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(marks):
            odd = np.union1d(odd, np.searchsorted(starts, marks, side="right") - 1)
        text = lambda at: [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

        def make(at: np.ndarray) -> np.ndarray:
            entries = np.empty(len(at), np.int32)
            inner = cut[at]
            entries[inner] = self._by_merges(folded, starts[at[inner]], (ends - starts)[at[inner]])
            entries[~inner] = self._by_tokenizer(text(at[~inner]))
            return entries

        ids, total = self.pool.ids(keys, odd, make, lambda at: self._by_tokenizer(text(at)))
        return ids, total[np.searchsorted(starts, offsets)]


@lru_cache(2)
def unit_cache(tokenizer_file: str) -> UnitCache:
    return UnitCache(tokenizer_file)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of many documents' ranked ids laid end to end, and how many of each a document has."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    blocks = -(-counts // 4)
    shift = (np.cumsum(blocks) - blocks) * 4 - (np.cumsum(counts) - counts)
    codes = np.zeros(int(blocks.sum()) * 4, np.uint8)
    codes[np.arange(len(ranks)) + np.repeat(shift, counts)] = lengths - 1
    codes = codes.reshape(-1, 4)
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])]
    return codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6, data, blocks, np.diff(ends)


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranked ids of many documents, from their control and data bytes laid end to end."""
    blocks = -(-counts // 4)
    present = np.arange(int(blocks.sum()) * 4) - np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]) * 4, blocks * 4) < np.repeat(counts, blocks * 4)
    lengths = LENGTHS[control].reshape(-1)[present]
    starts = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[starts].astype(np.uint32)
    for i in range(1, 4):
        longer = np.flatnonzero(lengths > i)
        out[longer] |= padded[starts[longer] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _cut(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive pieces of the bytes as binary values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def id_kind(tokenizer_file: str, end_id: int) -> np.dtype:
    """Two bytes an id between the steps, if that is enough for the vocabulary."""
    from tokenizers import Tokenizer

    return np.dtype("<u2" if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")


def tokenised(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str, text_col: str, kind: np.dtype) -> DataFrame:
    """doc_id, ids (of that kind, the end id last)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = unit_cache(tokenizer_file)
        for batch in K.slices(batches, most=2 << 20):
            ids, offsets = cache.encode(*K.utf8(batch.column("text")))
            ids = np.insert(ids, offsets[1:], np.uint32(end_id)).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _cut(ids.view(np.uint8), kind.itemsize * (np.diff(offsets) + 1))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(encoded: DataFrame, kind: np.dtype) -> np.ndarray:
    """How often each id occurs, over all documents; the driver gets one row per id of the vocabulary."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, _ = _concatenated(batch.column("ids"))
            found = np.bincount(data.view(kind))
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def _concatenated(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Write the folder `path` (a new one among the scratch tables if there is none): files, and ranks with the id of each rank. Returns it."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "tokens")
    encoded_at = new_path(spark, "token_ids")
    kind = id_kind(tokenizer_file, end_id)
    tokenised(docs, tokenizer_file, end_id, id_col, text_col, kind).write.option("compression", "zstd").parquet(encoded_at)
    encoded = spark.read.schema("doc_id long, ids binary").parquet(encoded_at)
    counts = id_counts(encoded, kind)
    by_rank = np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.empty(len(counts), np.uint32)
    rank_of[by_rank] = np.arange(len(counts), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, position = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = _concatenated(batch.column("ids"))
            ranked, offsets = ranks.value[data.view(kind)], offsets // kind.itemsize
            n = np.diff(offsets)
            control, coded, blocks, sizes = pack(ranked, n)
            starts = position + np.cumsum(n) - n
            position += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), batch.column("doc_id"), pa.array(n), _cut(control, blocks), _cut(coded, sizes)],
                names=["part", "position", "doc_id", "n_tokens", "control", "data"],
            )

    # rows that repeat an id follow each other by a hash of their ids, so reruns agree
    encoded.orderBy("doc_id", F.xxhash64("ids")).mapInArrow(run, FILES).write.option("compression", "zstd").parquet(f"{path}/files")
    discard(spark, encoded_at)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian 32-bit) from the folder alone."""
    files = spark.read.schema(FILES).parquet(f"{path}/files")
    # one row per id of the vocabulary
    by_rank = spark.read.schema("rank int, id long").parquet(f"{path}/ranks").orderBy("rank").toArrow().column("id").to_numpy().astype(np.uint32)
    names = spark.sparkContext.broadcast(by_rank)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n_tokens").to_numpy()
            ids = names.value[unpack(_concatenated(batch.column("control"))[0], _concatenated(batch.column("data"))[0], counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), _cut(ids.astype("<u4").view(np.uint8), counts * 4)], names=["doc_id", "start", "ids"])

    # one row per file: always small enough to send along
    placed = files.join(F.broadcast(before), F.col("part") == F.col("__part")).select("doc_id", (F.col("position") + F.col("before")).alias("start"), "n_tokens", "control", "data")
    return placed.mapInArrow(run, "doc_id long, start long, ids binary")
