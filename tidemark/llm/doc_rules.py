"""Quality rules: gradient-boosted trees over document statistics, with a fixed base rule before them.

Statistics are counted in one scan with numpy. The trees are grown on a bounded sample of labelled rows (MAX_TRAIN, by
hash order of the id), with monotonic constraints: more symbols, repeated words, repeated lines, capitals or bars can
only lower a score. A model is four flat numpy arrays; scoring walks all rows down one level of all nodes at a time.

Defined cases: a null text counts as empty and fails the base rule; labels that are null or whose document is missing
are ignored; several labels of an id count by their mean; without labels of both kinds every document scores the mean
label (1 without any); rows that repeat an id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as K
from tidemark.llm.shared import lean, materialise

MAX_TRAIN = 20_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_bars", "n_distinct", "n_stops", "n_doubled"]
FEATURES = ["mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "bars", "distinct", "stops", "doubled", "words_per_line", "log_words"]
#: -1: a higher value may not raise the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "bars": -1, "doubled": -1}


def _flags(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_IS = {"n_symbols": _flags(SYMBOLS), "n_upper": _flags(bytes(range(65, 91))), "n_digits": _flags(b"0123456789"), "n_marks": _flags(b"!?"), "n_bars": _flags(b"|"), "n_stops": _flags(b".,;:")}


def count_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text, as int64 arrays."""
    n = len(offsets) - 1
    starts, ends, word_offsets = K.words(data, offsets)
    doc = K.doc_of(word_offsets)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    chars = (data & 0xC0) != 0x80
    out = {k: total(v[data]) for k, v in _IS.items()}
    out["n_words"] = np.diff(word_offsets)
    out["n_chars"], out["word_chars"] = total(chars), total(chars & ~K.SPACES[data])
    rolling = K.Rolling(data)
    hashes = rolling.of(starts, ends)
    order, first = K.run_ranks(hashes, doc)
    out["n_distinct"] = np.bincount(doc[order][first], minlength=n)
    doubled = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out["n_doubled"] = np.bincount(doc[1:][doubled], minlength=n)

    at, tri = K.windows(hashes, word_offsets, 3)
    order, first = K.run_ranks(tri, doc[at])
    single = first & np.append(first[1:], True)[: len(first)]
    repeated = K.cover(at[order[~single]], 3, len(hashes))
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=n)

    line_starts, line_ends, line_offsets = K.lines(data, offsets)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_doc = K.doc_of(line_offsets)[has_word]
    order, first = K.run_ranks(rolling.of(line_starts[has_word], line_ends[has_word]), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[order][~first], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def feature_matrix(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    of = {
        "mean_word": c["word_chars"] / words, "symbols": c["n_symbols"] / words, "dup_lines": c["n_dup_lines"] / lines, "repeats": c["n_repeat_words"] / words,
        "upper": c["n_upper"] / chars, "digits": c["n_digits"] / chars, "marks": c["n_marks"] / words, "bars": c["n_bars"] / words, "distinct": c["n_distinct"] / words,
        "stops": c["n_stops"] / words, "doubled": c["n_doubled"] / words, "words_per_line": words / lines, "log_words": np.log1p(c["n_words"]),
    }
    return np.column_stack([of[k] for k in FEATURES])


@dataclass
class Trees:
    """Complete binary trees of one depth: node arrays (trees, 2**depth - 1), leaf values (trees, 2**depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        nodes = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < nodes:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - nodes]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 5.0) -> Trees:
    """Histogram boosting with logistic loss. monotone: feature number to +1 or -1.

    A constrained split must order its two sides, and their middle bounds all leaves below, which keeps whole trees monotonic.
    """
    nodes = 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    start = float(np.log(mean / (1 - mean)))
    model = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1)), start)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            low, high = bounds[node]
            best, chosen = 1e-6, None
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 20:
                    continue
                gs = np.cumsum(np.bincount(codes[rows, j], g[rows], len(e) + 1))
                hs = np.cumsum(np.bincount(codes[rows, j], h[rows], len(e) + 1))
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                wl, wr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                gain = wl * gl - 0.5 * wl**2 * (hl + l2) + wr * gr - 0.5 * wr**2 * (hr + l2)
                w = np.clip(gs[-1] / (hs[-1] + l2), low, high)
                gain -= w * gs[-1] - 0.5 * w**2 * (hs[-1] + l2)
                sign = monotone.get(j, 0)
                gain[(hl < 1) | (hr < 1) | (sign * (wr - wl) < 0)] = -np.inf
                if gain.max() > best:
                    i = int(gain.argmax())
                    best, chosen = gain[i], (j, e[i], sign, (wl[i] + wr[i]) / 2)
            left, right = (low, high), (low, high)
            if chosen:
                j, edge, sign, middle = chosen
                model.feature[t, node], model.threshold[t, node] = j, edge
                if sign:
                    left, right = ((low, middle), (middle, high)) if sign > 0 else ((middle, high), (low, middle))
                at[rows] = 2 * node + 1 + (x[rows, j] > edge)
            else:
                at[rows] = 2 * node + 1
            bounds[2 * node + 1], bounds[2 * node + 2] = left, right
        for leaf in range(nodes + 1):
            rows = at == nodes + leaf
            low, high = bounds[nodes + leaf]
            model.value[t, leaf] = rate * np.clip(g[rows].sum() / (h[rows].sum() + l2), low, high)
        total += model.value[t][at - nodes]
    return model


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and COUNTS of every row."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            counts = count_statistics(*K.utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(counts[k]) for k in COUNTS)], names=["id", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{k} long" for k in COUNTS))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, rule_score, kept."""
    counted = materialise(statistics(docs, id_col, text_col), "doc_statistics")
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("label"))
    sample = counted.join(marks, "id").orderBy(F.xxhash64("id"), "id").limit(max_train).toPandas()
    x = feature_matrix({k: sample[k].to_numpy() for k in COUNTS})
    monotone = {FEATURES.index(k): v for k, v in MONOTONE.items()}
    model = fit_trees(x, (sample["label"].to_numpy(float) >= 0.5).astype(float), monotone)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {k: batch.column(k).to_numpy() for k in COUNTS}
            failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
            score = model.score(feature_matrix(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(k) for k in COUNTS[:5]), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                names=[id_col, *COUNTS[:5], "base_failed", "rule_score", "kept"],
            )

    return counted.mapInArrow(run, f"`{id_col}` long, " + ", ".join(f"{k} long" for k in COUNTS[:5]) + ", base_failed boolean, rule_score double, kept boolean")
