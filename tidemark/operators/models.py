"""Preprocessing, linear models on Gram matrices, logistic regression, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normalize import clip, sigmoid

#: The grids of the model selection.
RIDGE_ALPHAS = [1e-5, 1e-4, 1e-3, 1e-2, 1e-1]
NET_ALPHAS, NET_RATIOS = [1e-4, 1e-3, 1e-2, 1e-1], [0.15, 0.5, 0.85]
NEIGHBOURS = [5, 15, 30, 60]
LOGISTIC_L2 = [1e-4, 1e-3, 1e-2, 1e-1, 1.0]
THRESHOLDS = [0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65]


def exact_quantiles(rows: DataFrame, columns: list[str], shares: tuple[float, ...], accuracy: int = 10_000) -> dict[str, list[float]]:
    """Interpolated quantiles, exact at any size. NULL counts as absent; a column without values has NaN.

    Approximate quantiles a little below and above each share bracket it; only the rows inside brackets, a few
    ten-thousandths of the input each, are counted by value and ranked.
    """
    counted = rows.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    wide = [max(2 / accuracy, 3 / max(n, 1)) for n in counted]
    around = lambda w: [x for p in shares for x in (max(p - w, 0.0), min(p + w, 1.0))]
    edges = rows.agg(*[F.percentile_approx(c, around(w), accuracy).alias(f"e{i}") for i, (c, w) in enumerate(zip(columns, wide, strict=True))]).first()
    spans = [(i, j, n, *edges[i][2 * j : 2 * j + 2]) for i, n in enumerate(counted) if n for j in range(len(shares))]
    out = {c: [float("nan")] * len(shares) for c in columns}
    if not spans:
        return out
    below = rows.agg(*[F.count_if(F.col(columns[i]) < low).alias(f"b{k}") for k, (i, _, _, low, _) in enumerate(spans)]).first()
    inside = F.array(*[F.struct(F.lit(k).alias("k"), F.col(columns[i]).cast("double").alias("x"), F.col(columns[i]).between(low, high).alias("inside")) for k, (i, _, _, low, high) in enumerate(spans)])
    counts = rows.select(F.explode(F.filter(inside, lambda s: s["inside"])).alias("s")).groupBy("s.k", "s.x").agg(F.count(F.lit(1)).alias("c"))
    ends = F.sum("c").over(W.partitionBy("k").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    at = [(n - 1) * shares[j] for _, j, n, _, _ in spans]
    ranks = rows.sparkSession.createDataFrame([(k, int(h) - below[k], min(int(h) + 1, spans[k][2] - 1) - below[k]) for k, h in enumerate(at)], "k int, lower long, upper long")
    hit = lambda r: (F.col(r) < F.col("to")) & (F.col(r) >= F.col("to") - F.col("c"))
    found = counts.withColumn("to", ends).join(F.broadcast(ranks), "k").filter(hit("lower") | hit("upper")).select("k", "x", hit("lower").alias("low"), hit("upper").alias("up"))
    values: dict = {}
    for r in found.collect():  # two rows a quantile at the most
        for end, here in ((0, r.low), (1, r.up)):
            if here:
                values[r.k, end] = r.x
    for k, (i, j, *_) in enumerate(spans):
        low, up = values[k, 0], values[k, 1]
        out[columns[i]][j] = low + (up - low) * (at[k] - int(at[k]))
    return out


def fit_preprocessor(rows: DataFrame, features: list[str]) -> dict[str, tuple[float, float, float, float, float]]:
    """Per feature median, 1st and 99th percentile (exact, interpolated), mean and spread after imputing and clipping."""
    q = exact_quantiles(rows, features, (0.5, 0.01, 0.99))
    filled = {f: clip(F.coalesce(f, F.lit(q[f][0])), q[f][1], q[f][2]) for f in features}
    m = rows.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(f) for f, c in filled.items()]).first()
    return {f: (*q[f], m[f][0], m[f][1] if m[f][1] > 1e-12 else 1.0) for f in features}


def fit_target(rows: DataFrame, target: str) -> tuple[float, float, float, float]:
    """1st and 99th percentile of a centred target, mean and spread after clipping."""
    low, high = exact_quantiles(rows, [target], (0.01, 0.99))[target]
    mean, scale = rows.agg(F.avg(clip(F.col(target), low, high)), F.stddev_pop(clip(F.col(target), low, high))).first()
    return low, high, mean, scale if scale > 1e-12 else 1.0


def scaled_target(target: str, fitted: tuple[float, float, float, float]) -> Column:
    """M5: clipped and scaled."""
    low, high, mean, scale = fitted
    return (clip(F.col(target), low, high) - mean) / scale


def standardise(rows: DataFrame, fitted: dict[str, tuple]) -> DataFrame:
    """M4: impute, clip, scale; fitted numbers are literals."""
    return rows.withColumns({f: (clip(F.coalesce(f, F.lit(med)), low, high) - mean) / scale for f, (med, low, high, mean, scale) in fitted.items()})


def excess(target: str) -> Column:
    """Deviation from the day's mean."""
    return F.col(target) - F.avg(target).over(W.partitionBy("date"))


def gram(rows: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X / n and X'y / n by one aggregation."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = [F.sum(F.col(features[i]) * F.col(features[j])) for i, j in pairs] + [F.sum(F.col(f) * F.col(target)) for f in features]
    *values, n = rows.agg(*sums, F.count(F.lit(1))).first()
    g = np.zeros((len(features), len(features)))
    for (i, j), v in zip(pairs, values, strict=False):
        g[i, j] = g[j, i] = v / n
    return g, np.array(values[len(pairs) :]) / n, n


def ridge(g: np.ndarray, c: np.ndarray, alpha: float) -> np.ndarray:
    """M6, M7"""
    return np.linalg.solve(g + alpha * np.eye(len(c)), c)


def elastic_net(g: np.ndarray, c: np.ndarray, alpha: float, l1: float, tolerance: float = 1e-8, sweeps: int = 300) -> np.ndarray:
    """M8: cyclic coordinate descent on the Gram matrix."""
    b = np.zeros(len(c))
    for _ in range(sweeps):
        old = b.copy()
        for j in range(len(c)):
            rho = c[j] - g[j] @ b + g[j, j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (g[j, j] + alpha * (1 - l1))
        if np.abs(b - old).max() < tolerance:
            break
    return b


def linear_score(features: list[str], coefficients, scale: float = 1.0, mean: float = 0.0) -> Column:
    """M9"""
    total = F.lit(0.0)
    for f, b in zip(features, coefficients, strict=True):
        total = total + F.col(f) * float(b)
    return total * scale + mean


def composite_score(features: list[str], signs, scale: float = 1.0) -> Column:
    """Features by their training signs; no mean is added."""
    n = len(features)
    return linear_score(features, [float(np.sign(s)) / n for s in signs], scale / n**0.5)


def logistic(rows: DataFrame, features: list[str], up: str, l2: float, iterations: int = 100, tolerance: float = 1e-6) -> tuple[float, np.ndarray]:
    """Diagonal Newton steps of at most 1, one aggregation each; gradients from the start of the step (Q21)."""
    return logistics(rows, features, up, [l2], iterations, tolerance)[0]


def logistics(rows: DataFrame, features: list[str], up: str, penalties: list[float], iterations: int = 100, tolerance: float = 1e-6) -> list[tuple[float, np.ndarray]]:
    """M12 for several penalties: all of them that still move share one pass over the rows a step."""
    rows = rows.select(*features, F.col(up).cast("double").alias("__y")).persist()
    try:
        n, rate = rows.agg(F.count(F.lit(1)), F.avg("__y")).first()
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        found = [(float(np.log(rate / (1 - rate))), np.zeros(len(features))) for _ in penalties]
        moving = list(range(len(penalties)))
        for _ in range(iterations):
            step, sums = rows, []
            for k in moving:
                intercept, b = found[k]
                p = sigmoid(linear_score(features, b) + intercept)
                step = step.withColumn(f"__p{k}", p).withColumn(f"__e{k}", F.col("__y") - F.col(f"__p{k}")).withColumn(f"__w{k}", F.greatest(F.col(f"__p{k}") * (1 - F.col(f"__p{k}")), F.lit(1e-6)))
                e, w = F.col(f"__e{k}"), F.col(f"__w{k}")
                sums += [F.sum(e), F.sum(w), *[F.sum(e * F.col(f)) for f in features], *[F.sum(w * F.col(f) * F.col(f)) for f in features]]
            values = np.array(step.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()).reshape(len(moving), -1)
            left = []
            for k, row in zip(moving, values, strict=True):
                intercept, b = found[k]
                g, h = row[2 : 2 + len(b)] / n, row[2 + len(b) :] / n
                moves, first = np.clip((g - penalties[k] * b) / (h + penalties[k]), -1, 1), row[0] / row[1]
                found[k] = intercept + float(np.clip(first, -1, 1)), b + moves
                if max(abs(first), np.abs(moves).max(initial=0)) >= tolerance:
                    left.append(k)
            if not (moving := left):
                break
        return found
    finally:
        rows.unpersist()


def _near(x: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of x, id and squared distance of its k nearest rows of the matrix; ties by id.

    Products of blocks find all rows that may be among the k nearest; their distances are then taken exactly.
    """
    k, norms, found = min(k, len(ids)), (matrix**2).sum(axis=1), []
    for start in range(0, len(x) if k else 0, block):
        part = x[start : start + block]
        own = (part**2).sum(axis=1)[:, None]
        rough = own + norms[None, :] - 2 * part @ matrix.T
        slack = 1e-9 * (own[:, 0] + norms.max()) + 1e-12
        row, col = np.nonzero(rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        exact = ((part[row] - matrix[col]) ** 2).sum(axis=1)
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        found.append((row[keep] + start, ids[col[keep]], exact[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column as a matrix, without Python lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def nearest(queries: DataFrame, train: DataFrame, k: int, most: int = 8_000_000) -> DataFrame:
    """(query_id, train_id, d2, place) of the k nearest; ties by id (Q18). queries, train: (id, vec).

    Training rows of `most` numbers together are sent to all tasks. More of them are cut into blocks by id; every block
    of queries meets every block of training rows in a task of its own, and the k nearest of all blocks remain.
    """
    schema = "query_id long, train_id long, d2 double"
    queries, train = queries.select("id", "vec"), train.select("id", "vec")
    rows, size = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    if size <= most:
        known = train.orderBy("id").toArrow()
        held = queries.sparkSession.sparkContext.broadcast((known.column("id").to_numpy(), _matrix(known.column("vec"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = held.value
            for batch in batches:
                if batch.num_rows:
                    row, near, d2 = _near(_matrix(batch.column("vec")), ids, matrix, k)
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column("id").to_numpy()[row]), pa.array(near), pa.array(d2)], names=["query_id", "train_id", "d2"])

        found = queries.mapInArrow(run, schema)
    else:
        blocks, per = -(-size // most), max(1, most * rows // size)
        parts = max(1, -(-queries.count() // per))
        every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
        left = queries.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("q"), every(blocks, "t"))
        right = train.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("t"), every(parts, "q"))

        def meet(own: pa.Table, other: pa.Table) -> pa.Table:
            row, near, d2 = _near(_matrix(own.column("vec")), other.column("id").to_numpy(), _matrix(other.column("vec")), k) if own.num_rows and other.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            return pa.table({"query_id": own.column("id").to_numpy()[row] if own.num_rows else row, "train_id": near, "d2": d2})

        found = left.groupBy("q", "t").cogroup(right.groupBy("q", "t")).applyInArrow(meet, schema)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("d2", "train_id")).cast("long")
    return found.withColumn("place", place).filter(F.col("place") <= k)


def neighbour_mean(near: DataFrame, targets: DataFrame) -> DataFrame:
    """Distance-weighted mean; exact matches alone if there are any. targets: (train_id, y)."""
    exact = F.col("d2") <= 1e-24
    weight = 1 / F.sqrt(F.greatest("d2", F.lit(1e-24)))
    joined = near.join(targets, "train_id")
    return joined.groupBy("query_id").agg(F.coalesce(F.avg(F.when(exact, F.col("y"))), F.try_divide(F.sum(weight * F.col("y")), F.sum(weight))).alias("prediction"))
