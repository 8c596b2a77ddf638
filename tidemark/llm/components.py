"""Connected components by repeated contraction, with DataFrame functions on written tables.

Each round first joins what is in one partition with a local union-find, which leaves a forest of stars, then hooks every node to the neighbour (or itself) that comes first in a random order and renames both ends of all
edges; edges inside a set vanish. The number of nodes falls by a constant factor a round, so rounds grow with the
logarithm of the longest chain. Joins have plain exchanges on both sides, which adaptive execution splits where a node
has very many edges. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import lean, materialise


#: A local union-find takes about so many edges; what is left after some rounds fits one task and ends there.
PER_TASK = 200_000


def _join_locally(edges: DataFrame, count: int) -> DataFrame:
    """Each partition's edges replaced by edges of its nodes to the first node (by rank) of their local component."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        rank: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            rank.update(zip(a, batch.column("ra").to_pylist(), strict=True))
            rank.update(zip(b, batch.column("rb").to_pylist(), strict=True))
            for x, y in zip(a, b, strict=True):
                x, y = find(x), find(y)
                if x != y:
                    if (rank[y], y) < (rank[x], x):
                        x, y = y, x
                    parent[y] = x
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([parent[x] for x in nodes], pa.int64())], names=["a", "b"])

    parts = -(-count // PER_TASK)
    ranked = edges.select("a", "b", F.xxhash64("a").alias("ra"), F.xxhash64("b").alias("rb"))
    return (ranked.coalesce(1) if parts < 2 else ranked.repartition(parts, "a")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) to (node, root): one row per node of an edge; root is the smallest node of its component.

    Loops and repeated edges are allowed; an edge with a null end is ignored; no edges give an empty result.
    """
    first = materialise(edges.filter("a is not null and b is not null").select("a", "b").distinct(), "edges")
    current, hooks = first.filter("a <> b"), []
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("id"))
    while count := current.count():
        turn = len(hooks)
        current = materialise(_join_locally(current, count), f"forest_{turn}")
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("node"), F.least("best", rank("a"))["id"].alias("to"))
        hook = materialise(hook, f"hooks_{turn}")
        hooks.append(hook)
        ends = lambda c, hook=hook: hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        renamed = current.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        current = materialise(renamed.filter("a <> b").distinct(), f"edges_{turn}")
    if not hooks:
        return first.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    labels = hooks[0]
    for turn, hook in enumerate(hooks[1:]):
        step = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        labels = materialise(labels.join(step, "to", "left").select("node", F.coalesce("next", "to").alias("to")), f"labels_{turn}")
    roots = labels.groupBy("to").agg(F.min("node").alias("root"))
    loops = first.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    found = labels.join(roots, "to").select("node", "root")
    return found.unionAll(loops.join(found.select("node"), "node", "left_anti"))
