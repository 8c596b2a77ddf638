"""Merge-type subword encoding by a prefix table, exact with the sentencepiece library.

In such an encoding a token sequence is the encoding of its text exactly if every neighbouring pair is the encoding of
its own concatenation. So every prefix of a text has one possible last token: of the vocabulary's matches that end
there, found by an automaton, the one that fits the last token of the prefix before it. The table of last tokens is
filled left to right in one pass and the ids are read off backwards from the end.

No piece joins a character to a space mark behind it, nor (checked when the model is loaded) a newline to anything, so
a text falls into chunks with encodings of their own, and a bounded pool keeps those met before, known by 64-bit hashes. Pieces of
space marks alone tie in score; a chunk with several space marks is therefore merged step by step, in the library's
order (best score, then leftmost).

Characters without a piece become their bytes' pieces. Defined cases: null and empty texts have no ids and decode to
the empty text; texts of any length are encoded whole; repeated rows are encoded each; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.shared import lean
from tidemark.llm.units import Pool

SPACE = "▁"
#: Chunks and fitting pairs that a worker keeps, and the bytes of a chunk that is kept.
CACHED, PAIRS, LONGEST = 600_000, 1 << 18, 64


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.library.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes | None] = [None] * n
        for i in range(n):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, self.library.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in self.ids):
            raise ValueError("a piece crosses the chunk boundaries")
        #: by two neighbouring ASCII characters: whether some piece has them so
        self.inside = np.zeros((128, 128), bool)
        for piece in self.ids:
            codes = [32 if c == SPACE else ord(c) for c in piece]
            for x, y in zip(codes[:-1], codes[1:], strict=True):
                if x < 128 and y < 128:
                    self.inside[x, y] = True
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.fits = lru_cache(PAIRS)(lambda left, right: self.merge(left + right) == [left, right])
        self.token_ids = lru_cache(1 << 16)(lambda token: [self.ids[token]] if token in self.ids else [self.bytes[b] for b in token.encode()])
        self.pool = Pool(CACHED)
        self.plain = np.array([x is not None for x in self.surface])
        self.surface_sizes = np.array([len(x or b"") for x in self.surface], np.int32)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_bytes = np.frombuffer(b"".join(x or b"" for x in self.surface), np.uint8)

    def merge(self, text: str) -> list[str]:
        """Merge neighbouring symbols by best score, then leftmost, until no pair is a piece."""
        symbols: list[str | None] = list(text)
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        scores, heap = self.scores, []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(symbols) and (score := scores.get(joined := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-score, i, joined, j))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            if symbols[i] is None or right[i] != j or symbols[j] is None or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j], right[i] = joined, None, right[j]
            if right[i] < len(symbols):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [s for s in symbols if s is not None]

    def last_tokens(self, text: str) -> list[str]:
        """For each prefix of the text the last token of its encoding.

        The automaton holds the pieces of two characters and more; where none of them fits, the last token is the character.
        """
        last: list[str] = []
        known, fits = 0, self.fits
        for end, (piece, size) in self.automaton.iter(text):
            if end < known:
                continue
            if end > known:
                last += text[known:end]
                known = end
            if size > end or fits(last[end - size], piece):
                last.append(piece)
                known += 1
        last += text[known:]
        return last

    def encode_chunk(self, chunk: str) -> list[int]:
        if chunk.startswith(SPACE * 2):
            tokens = self.merge(chunk)
        else:
            last, tokens, end = self.last_tokens(chunk), [], len(chunk)
            while end:
                token = last[end - 1]
                tokens.append(token)
                end -= len(token)
            tokens.reverse()
        return [i for token in tokens for i in self.token_ids(token)]

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (their UTF-8 bytes end to end) end to end, and n + 1 offsets.

        A text begins with a space mark; chunks begin at newlines, at the first of several space marks, and between ASCII
        characters that no piece has side by side.
        """
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.empty(0, np.int64)
        if len(mark):  # space marks in the text itself are spaces
            kept = np.ones(len(data), bool)
            kept[np.concatenate([mark + 1, mark + 2])] = False
            data = np.where(np.isin(np.arange(len(data)), mark), np.uint8(32), data)
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            data = data[kept]
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], np.uint8(32))
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut |= data == 10
        plain = data < 128
        cut[1:] |= plain[1:] & plain[:-1] & ~self.inside[data[:-1] & 127, data[1:] & 127]
        cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        raw = data.tobytes()

        def make(at: np.ndarray) -> np.ndarray:
            found = [self.encode_chunk(raw[a:b].decode().replace(" ", SPACE)) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            return self.pool.keep(np.fromiter(chain.from_iterable(found), np.uint32), np.array(list(map(len, found)), np.int64))

        ids, total = self.pool.ids(K.Rolling(data).of(starts, ends), np.flatnonzero(ends - starts > LONGEST), make, make)
        return ids, total[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, uint32."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of many documents' ids laid end to end."""
        sizes = self.surface_sizes[ids].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(total[-1])
        at += np.repeat(self.surface_starts[ids] - total[:-1], sizes)
        data, cuts = self.surface_bytes[at], total[offsets]
        filled = np.flatnonzero(np.diff(cuts) > 0)
        lead = cuts[filled][data[cuts[filled]] == 32]  # the space mark before the text
        data = np.delete(data, lead)
        cuts = cuts - np.searchsorted(lead, cuts)
        texts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        try:
            if not self.plain[ids].all():
                raise pa.ArrowInvalid("special ids")
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
        return texts.cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        """The text of ids; sequences that are no encodings (special ids, broken bytes) go to the library."""
        try:
            data = b"".join(map(self.surface.__getitem__, ids))
            text = data.decode()
        except (TypeError, UnicodeDecodeError):
            return self.library.decode(ids)
        return text[1:] if ids and self.surface[ids[0]][:1] == b" " else text


@lru_cache(2)
def codec(model_file: str) -> PieceCodec:
    """One codec per process and model."""
    return PieceCodec(model_file)


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids array<int>, decoded."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in K.slices(batches, most=1 << 20):
            values, offsets = own.encode_all(*K.utf8(batch.column("text")))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids, own.decode_all(values, offsets)], names=[id_col, "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>, decoded string")
