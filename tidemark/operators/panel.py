"""Calendar, status ledger, membership, splits: what a security was on a day."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normalize import first_value, limit_rate, strict_date

#: Fixed value: sessions after which a security counts as listed for a year.
MIN_LISTING = 250
#: Fixed value: a price touches its limit within this tolerance.
TOUCH = Decimal("0.0001")


def calendar(rows: DataFrame) -> DataFrame:
    """(date, pos), one row per distinct date."""
    return rows.select("date").filter("date is not null").distinct().withColumn("pos", F.row_number().over(W.orderBy("date")).cast("long") - 1)


def mondays(start: Column, end: Column) -> Column:
    """An array of the Mondays from start to end."""
    first = F.next_day(F.date_sub(start, 1), "MON")
    return F.when(first <= end, F.sequence(first, end, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))


def dedupe_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in file order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def listing(rows: DataFrame, cal: DataFrame) -> DataFrame:
    """(code, listing_date, listing_pos) from the first observed date."""
    first = rows.groupBy("code").agg(F.min("date").alias("listing_date"))
    return first.join(cal.select(F.col("date").alias("listing_date"), F.col("pos").alias("listing_pos")), "listing_date")


def listing_age(pos: Column, listing_pos: Column) -> Column:
    """C8"""
    return F.greatest(pos - listing_pos + 1, F.lit(0))


def listing_status(age: Column, least: int = MIN_LISTING) -> Column:
    """C9"""
    return F.when(age <= 0, "not_listed").when(age < least, "listed_less_than_one_year").otherwise("listed_at_least_one_year")


def price_limit_status(trading: Column, age: Column, high: Column, low: Column, preclose: Column, rate: Column) -> Column:
    """Decimal limits, half up to a cent."""
    up, down = F.round(preclose * (1 + rate), 2), F.round(preclose * (1 - rate), 2)
    at_up, at_down = high >= up - F.lit(TOUCH), low <= down + F.lit(TOUCH)
    return F.when(~trading, "not_applicable").when(age <= 1, "none").when(at_up & at_down, "limit_up_and_down").when(at_up, "limit_up").when(at_down, "limit_down").otherwise("none")


def trading_status(age: Column, quality: Column, tradestatus: Column) -> Column:
    """C11"""
    missing = F.when(tradestatus == 0, "suspended").otherwise("missing_data")
    known = F.when(tradestatus == 0, "suspended").when(tradestatus == 1, "trading").otherwise("unknown")
    return F.when(age <= 0, "not_listed").when(quality.isNull(), "no_record").when(quality == "missing", missing).when(quality == "invalid_format", "invalid_data").otherwise(known)


def security_status(trading: Column, age: Column, limit: Column, least: int = MIN_LISTING) -> Column:
    """C12"""
    idle = trading.isin("suspended", "missing_data", "invalid_data", "no_record")
    return F.when(age <= 0, "not_listed").when(idle, trading).when(trading == "unknown", "unknown").when(age < least, "listed_less_than_one_year").when(limit.isin("limit_up", "limit_down", "limit_up_and_down"), limit).otherwise("normal")


def status_ledger(rows: DataFrame, least: int = MIN_LISTING) -> DataFrame:
    """Every date of the calendar by every code. rows: bars with quality and tradestatus."""
    cal = calendar(rows)
    grid = cal.crossJoin(listing(rows, cal))
    money = lambda c: F.col(c).cast("decimal(18,4)")
    joined = grid.join(rows.select("date", "code", "high", "low", "preclose", "quality", "tradestatus"), ["date", "code"], "left").withColumn("age", listing_age(F.col("pos"), F.col("listing_pos")))
    joined = joined.withColumn("trading_status", trading_status(F.col("age"), F.col("quality"), F.col("tradestatus")))
    limit = price_limit_status(F.col("trading_status") == "trading", F.col("age"), money("high"), money("low"), money("preclose"), limit_rate(F.col("code"), F.lit(False)))
    joined = joined.withColumn("listing_status", listing_status(F.col("age"), least)).withColumn("price_limit_status", limit)
    return joined.withColumn("security_status", security_status(F.col("trading_status"), F.col("age"), F.col("price_limit_status"), least))


def clean_daily(rows: DataFrame, least: int = MIN_LISTING) -> DataFrame:
    """C14: complete rows of securities listed long enough, with their statuses."""
    ledger = status_ledger(rows, least).select("date", "code", "age", "listing_status", "trading_status", "price_limit_status", "security_status")
    return rows.filter("quality = 'complete'").join(ledger, ["date", "code"]).filter(F.col("age") >= least)


def membership_events(snapshots: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Member events and inferred removals. snapshots: (snapshot_date, effective_date, code)."""
    dates = snapshots.select("snapshot_date")
    dates = (dates.unionByName(manifest.select("snapshot_date")) if manifest is not None else dates).distinct()
    following = dates.withColumn("next", F.lead("snapshot_date").over(W.orderBy("snapshot_date")))
    present = snapshots.select(F.col("snapshot_date").alias("next"), "code")
    removed = snapshots.join(following, "snapshot_date").filter("next is not null").join(present, ["next", "code"], "left_anti")
    removed = removed.select(F.col("next").alias("snapshot_date"), F.col("next").alias("effective_date"), "code", F.lit("removed").alias("event_type"))
    return snapshots.select("snapshot_date", "effective_date", "code", F.lit("member").alias("event_type")).unionByName(removed)


def normalize_snapshot(rows: DataFrame, snapshot_date: str, prefix: str, industry: list[str], classification: list[str], update: list[str]) -> DataFrame:
    """One snapshot's constituents of an industry from raw text rows with aliased fields; a bad or repeated code is an error.

    The snapshot's date is the effective one: an update date may be older than its publication.
    """
    has = lambda names: [F.col(n) for n in names if n in rows.columns] or [F.lit(None).cast("string")]
    kept = rows.withColumn("__industry", F.upper(first_value(*has(industry)))).filter(F.col("__industry").startswith(prefix.upper()))
    day = F.to_date(F.lit(snapshot_date))
    out = kept.select(
        day.alias("snapshot_date"), day.alias("effective_date"), F.lower(first_value(*has(["code"]))).alias("code"), first_value(*has(["code_name", "codeName"])).alias("code_name"),
        F.lit(prefix.upper()).alias("industry_code"), F.coalesce(first_value(*has(classification)), F.lit("unknown")).alias("classification"), strict_date(first_value(*has(update))).alias("source_update_date"),
    )
    if not out.filter(~F.coalesce(F.col("code").rlike(r"^(sh|sz)\.\d{6}$"), F.lit(False))).isEmpty():
        raise ValueError(f"a code of the snapshot {snapshot_date} is malformed")
    if not out.groupBy("code").count().filter("count > 1").isEmpty():
        raise ValueError(f"the snapshot {snapshot_date} has a code twice")
    return out


def check_events(snapshots: DataFrame) -> None:
    """An effective date after its snapshot, or two of one code, are errors."""
    if not snapshots.filter("effective_date > snapshot_date").isEmpty():
        raise ValueError("an effective date is later than its snapshot")
    if not snapshots.groupBy("code", "effective_date").count().filter("count > 1").isEmpty():
        raise ValueError("a code has one effective date twice")


def membership_asof(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Each row with the latest event of its code by (snapshot, effective, removal last); one shuffle on code, no range join."""
    state = F.struct("snapshot_date", "effective_date", "event_type")
    left = rows.select("code", F.col("date").alias("t"), F.lit(1).alias("k"), F.lit(None).cast("date").alias("e"), F.lit(0).alias("r"), F.lit(None).cast("struct<snapshot_date:date,effective_date:date,event_type:string>").alias("s"), F.struct(*rows.columns).alias("row"))
    right = events.select("code", F.col("snapshot_date").alias("t"), F.lit(0).alias("k"), F.col("effective_date").alias("e"), (F.col("event_type") == "removed").cast("int").alias("r"), state.alias("s"), F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    order = W.partitionBy("code").orderBy("t", "k", "e", "r").rowsBetween(W.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("state", F.last("s", ignorenulls=True).over(order)).filter("k = 1").select("row.*", "state.*")


def point_in_time_panel(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Only rows whose latest visible event is a membership."""
    return membership_asof(rows, events).filter("event_type = 'member'")


def membership_audit(rows: DataFrame, events: DataFrame) -> DataFrame:
    """P5: how many rows a panel keeps, and why it drops the others."""
    state = F.coalesce(F.col("event_type"), F.lit("before_first_event"))
    return membership_asof(rows, events).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"))


def latest_names(*sources: DataFrame) -> DataFrame:
    """(code, code_name) from sources (code, code_name, at) in order; a later source overrides an earlier one, within one the latest row counts."""
    every = None
    for i, rows in enumerate(sources):
        one = rows.select("code", "code_name", F.struct(F.lit(i).alias("source"), F.col("at").alias("at")).alias("order"))
        every = one if every is None else every.unionByName(one)
    return every.filter("code_name is not null and code_name <> ''").groupBy("code").agg(F.max_by("code_name", "order").alias("code_name"))


def allocate(n: int, ratios: list[str]) -> list[int]:
    """M1: largest remainders; ties go to the earlier split; an empty split is an error."""
    shares = [Decimal(r) for r in ratios]
    if any(not s.is_finite() or s <= 0 for s in shares) or sum(shares) != 1:
        raise ValueError("ratios must be positive and sum to 1")
    quotas = [s * n for s in shares]
    counts = [int(q) for q in quotas]
    for i in sorted(range(len(counts)), key=lambda i: (counts[i] - quotas[i], i))[: n - sum(counts)]:
        counts[i] += 1
    if not all(counts):
        raise ValueError("a split would be empty")
    return counts


def assign_splits(rows: DataFrame, ratios: dict[str, str]) -> DataFrame:
    """M2: contiguous blocks of dates."""
    cal = calendar(rows)
    label, edge = None, 0
    for name, n in zip(ratios, allocate(cal.count(), list(ratios.values())), strict=True):
        edge += n
        label = F.when(F.col("pos") < edge, name) if label is None else label.when(F.col("pos") < edge, name)
    return rows.join(F.broadcast(cal.withColumn("split", label).select("date", "split")), "date")


def fold_bounds(dates: list, folds: int = 4) -> list[tuple[int, object, object]]:
    """M3: (fold, first, last test date); bounds are the truncated binary fractions 0.55 + 0.10 f."""
    n, out = len(dates), []
    for f in range(folds):
        begin = 0.55 + f * 0.10
        first, end = min(int(n * begin), n - 1), min(int(n * (begin + 0.10)), n)
        if end > first:
            out.append((f + 1, dates[first], dates[end - 1]))
    return out


def walk_forward(rows: DataFrame, end_col: str, folds: int = 4) -> DataFrame:
    """Rows by fold and role; training rows and their labels end before the fold starts."""
    dates = [r.date for r in rows.select("date").distinct().orderBy("date").collect()]
    bounds = rows.sparkSession.createDataFrame(fold_bounds(dates, folds), "fold long, start_date date, end_date date")
    test = F.col("date").between(F.col("start_date"), F.col("end_date"))
    train = (F.col("date") < F.col("start_date")) & (F.col(end_col) < F.col("start_date"))
    role = F.when(test, "test").when(train, "train")
    return rows.join(F.broadcast(bounds), train | test).withColumn("role", role)
