"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source wants target / source size copies. The whole part is granted; the fractional parts are
rounded against each other: of two documents one takes over probability from the other, weighted by size so that the
expected words stay the same, until one of them is 0 or 1. Chunks of FAN documents are folded this way, each leaving at
most one undecided document, and those are folded again, level by level, as a reduction tree over (source, chunk). A
chunk has about FAN rows whatever its source's share of the table, so a source with a third of all rows is folded by
as many tasks as the rest. Heavy documents are folded first, so what stays undecided is light as a rule. The root's one
undecided document is rounded to the nearer end, and documents that the root itself decided are turned, heavy ones first,
where that makes up for it: a source's taken words differ from the target by at most half its largest document, and
mostly by a few words.

Random numbers are hashes of ids, so reruns agree whatever the partitioning.

Defined cases: sources are ordered by code point with null last; null texts have size 0; a document without words is
taken 0 times; rows that repeat id, source and size are decided together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise

FAN = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size) to target: shares of the total by weight 1, 2, 3, ..., held at `most` times the size.

    One row per source comes in, so the windows over all rows are small. In order of cap per weight the capped sources
    are a prefix: a source is capped if its cap is below what the remaining weight would give it.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    caps = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = caps.rowsBetween(W.unboundedPreceding, -1), caps.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.sum("weight").over(after))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("open", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.coalesce("open", F.lit(0.0))))
        .select("source", "source_size", "target")
    )


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def _fold(units: Column, level: int, seed: int) -> Column:
    """Fold an array of (order, key, weight, p), heavy units first, into (open unit, decided units with p 0 or 1)."""
    unit = "struct<ord:double,key:binary,weight:double,p:double>"

    def step(state: Column, new: Column) -> Column:
        old = state["open"]
        mass = old["weight"] * old["p"] + new["weight"] * new["p"]
        # ends of the segment on which the expected words stay the same
        old_most = F.least(F.lit(1.0), mass / old["weight"])
        old_least = F.greatest(F.lit(0.0), (mass - new["weight"]) / old["weight"])
        new_most = F.least(F.lit(1.0), mass / new["weight"])
        new_least = F.greatest(F.lit(0.0), (mass - old["weight"]) / new["weight"])
        up = _chance(F.lit(seed), F.lit(level), old["key"], new["key"]) * (old_most - old_least) < (old["p"] - old_least)
        p_old = F.when(up, old_most).otherwise(old_least)
        p_new = F.when(up, new_least).otherwise(new_most)
        with_p = lambda u, p: F.struct(u["ord"].alias("ord"), u["key"].alias("key"), u["weight"].alias("weight"), p.alias("p"))
        # the unit that the end point makes integral is decided, the other stays open
        old_done = F.when(up, mass >= old["weight"]).otherwise(mass <= new["weight"])
        old_whole = F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))
        new_whole = F.when(up, F.lit(0.0)).otherwise(F.lit(1.0))
        return F.when(state["open"].isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(
                F.when(old_done, with_p(new, p_new)).otherwise(with_p(old, p_old)).alias("open"),
                F.concat(state["done"], F.array(F.when(old_done, with_p(old, old_whole)).otherwise(with_p(new, new_whole)))).alias("done"),
            )
        )

    start = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(f"array<{unit}>").alias("done"))
    return F.aggregate(units, start, step)


def _balance(left: Column, done: Column) -> Column:
    """The decided units, some turned (heavy ones first) where that makes up for rounding the unit left open to its nearer end."""
    unit = "struct<ord:double,key:binary,weight:double,p:double>"
    excess = F.coalesce((F.when(left["p"] >= 0.5, 1.0).otherwise(0.0) - left["p"]) * left["weight"], F.lit(0.0))

    def step(state: Column, u: Column) -> Column:
        change = F.when(u["p"] >= 0.5, -u["weight"]).otherwise(u["weight"])
        turn = F.abs(state["e"] + change) < F.abs(state["e"])
        turned = F.struct(u["ord"].alias("ord"), u["key"].alias("key"), u["weight"].alias("weight"), F.when(turn, 1 - u["p"]).otherwise(u["p"]).alias("p"))
        return F.struct(F.when(turn, state["e"] + change).otherwise(state["e"]).alias("e"), F.concat(state["out"], F.array(turned)).alias("out"))

    start = F.struct(excess.alias("e"), F.array().cast(f"array<{unit}>").alias("out"))
    return F.aggregate(F.sort_array(done), start, step)["out"]


def pivotal_round(units: DataFrame, largest: int, fan: int = FAN, seed: int = 17) -> DataFrame:
    """(grp, key binary, weight > 0, p in (0, 1)) with unique keys to (grp, key, taken 0 or 1).

    largest: rows of the largest group, from which the number of levels follows.
    """
    sizes = units.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / fan).cast("long")
    level_units = units.join(sizes.withColumnRenamed("grp", "__g"), F.col("grp").eqNullSafe(F.col("__g"))).select(
        "grp", F.pmod(F.xxhash64(F.lit(seed), "key"), chunks).alias("chunk"), F.struct((-F.col("weight")).alias("ord"), "key", "weight", "p").alias("u")
    )
    levels, heads = 1, max(1, -(-largest // fan))
    while heads > 1:
        levels, heads = levels + 1, -(-heads // fan)
    decided = None
    for level in range(levels):
        folded = level_units.groupBy("grp", "chunk").agg(F.sort_array(F.collect_list("u")).alias("us")).select("grp", "chunk", _fold(F.col("us"), level, seed).alias("f"))
        folded = folded.select("grp", "chunk", "f.open", "f.done")
        if level == levels - 1:  # one chunk a group is left
            folded = folded.withColumn("done", _balance(F.col("open"), F.col("done")))
        folded = materialise(folded, f"pivotal_{level}")
        done = folded.select("grp", F.explode("done").alias("u")).select("grp", "u.key", F.col("u.p").cast("int").alias("taken"))
        decided = done if decided is None else decided.unionAll(done)
        level_units = folded.filter("open is not null").select("grp", F.floor(F.col("chunk") / fan).cast("long").alias("chunk"), F.col("open").alias("u"))
    last = level_units.select("grp", "u.key", (F.col("u.p") >= 0.5).cast("int").alias("taken"))
    return decided.unionAll(last)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = 17) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # one unit per distinct (id, source, size); the key is a null-safe image of the three
    key = F.to_binary(F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("size").cast("string"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))), F.lit("utf-8"))
    units = materialise(rows.withColumn("key", key).groupBy("key", "id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "mix_units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = materialise(sizes, "mix_sources")
    targets = materialise(source_targets(sizes.select("source", "source_size"), most), "mix_targets")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    per_source = targets.withColumnRenamed("source", "__source").withColumn("rate", F.least(F.lit(float(most)), F.try_divide(F.col("target"), F.col("source_size").cast("double"))))
    wanted = units.join(per_source, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    open_units = wanted.filter("size > 0 and rate > floor(rate)").select(F.col("source").alias("grp"), "key", (F.col("size") * F.col("times")).cast("double").alias("weight"), (F.col("rate") - F.floor("rate")).alias("p"))
    rounded = pivotal_round(open_units, largest, seed=seed).select(F.col("key").alias("__key"), "taken")
    out = wanted.join(rounded, F.col("key") == F.col("__key"), "left")
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    out = out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), "times")
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("__i", "times")


def repeat_by_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = 17) -> DataFrame:
    """The input's rows and columns, each row as often as the mix takes it."""
    copies = mix(docs, id_col, text_col, source_col, most, seed).filter("copies > 0")
    copies = copies.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col("size").alias("__size"), "copies").distinct().withColumnRenamed("copies", "__copies")
    match = docs[id_col].eqNullSafe(copies["__id"]) & docs[source_col].eqNullSafe(copies["__source"]) & (word_count(docs[text_col]) == copies["__size"])
    turn = "_".join(["turn", *docs.columns])  # no column of the input can have this name
    return docs.join(copies, match).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), copies["__copies"])).alias(turn)).drop(turn)
