"""The queries of the catalogue in DuckDB SQL, from shared common table expressions."""

from __future__ import annotations

from tidemark.operators.factors import CONTEXT, FACTORS
from tidemark.plans.catalogue import FEATURES, VARIED


def r(names, places=6):
    return ", ".join(f"round({n}, {places}) + 0.0 as {n}" for n in names)


BARS = """
lines as (select p_brand as code, cast(l_shipdate as date) as date, l_extendedprice / l_quantity as price, l.* from lineitem l join part on l_partkey = p_partkey),
daily as (select code, date, first(price order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as open, max(price) as high, min(price) as low,
    last(price order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as close, cast(sum(l_quantity) as double) as volume,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount, case when max(l_discount) = 0 then 0 else 1 end as tradestatus from lines group by all),
bars as (select *, volume / 1000 as turn, coalesce(lag(close) over (partition by code order by date), open) * case when day(date) = 15 then 0.98::double else 1.0::double end as preclose from daily),
cal as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from bars))
"""
TRI = (
    BARS
    + """, stepped as (select *, row_number() over w as rn, case when row_number() over w = 1 then 1.0::double else close / preclose end as step from bars where tradestatus = 1 window w as (partition by code order by date)),
tri as (select *, product(step) over (partition by code order by date rows unbounded preceding) as tri from stepped)
"""
)


def _m(c, k, least=None):
    return f"case when rn >= {least or k} then avg({c}) over (w rows between {k - 1} preceding and current row) end"


FACTOR = (
    TRI
    + f""", moved as (select *, tri / nullif(lag(tri) over w, 0) - 1 as ret from tri window w as (partition by code order by date)),
factors as (select *, ret as return_1, tri / lag(tri, 5) over w - 1 as momentum_5, tri / lag(tri, 20) over w - 1 as momentum_20, tri / lag(tri, 60) over w - 1 as momentum_60,
  case when rn >= 21 then stddev_pop(ret) over (w rows between 19 preceding and current row) end as volatility_20,
  case when rn >= 61 then stddev_pop(ret) over (w rows between 59 preceding and current row) end as volatility_60,
  ({_m("tri", 5)}) / nullif({_m("tri", 20)}, 0) - 1 as sma_ratio_5_20, ({_m("tri", 20)}) / nullif({_m("tri", 60)}, 0) - 1 as sma_ratio_20_60,
  ({_m("volume", 5)}) / nullif({_m("volume", 20)}, 0) as volume_ratio_5_20, ({_m("amount", 5)}) / nullif({_m("amount", 20)}, 0) as amount_ratio_5_20,
  {_m("turn", 20)} as turnover_mean_20, turn as turnover_1, (high - low) / nullif(close, 0) as intraday_range,
  case when high <> low then (2 * close - high - low) / (high - low) else 0.0 end as close_location, open / nullif(preclose, 0) - 1 as open_gap,
  case when rn >= 21 and min(amount) over (w rows between 19 preceding and current row) > 0 then avg(abs(ret) / amount) over (w rows between 19 preceding and current row) * 1e8 end as amihud_20,
  {_m("greatest(ret, 0.0)", 14, 15)} as gain, {_m("greatest(-ret, 0.0)", 14, 15)} as loss from moved window w as (partition by code order by date)),
factored as (select *, case when gain = 0 and loss = 0 then 50.0 when loss = 0 then 100.0 else 100 - 100 / (1 + gain / nullif(loss, 0)) end as rsi_14 from factors)
"""
)


def context(of):
    return f""", returned as (select *, close / nullif(preclose, 0) - 1 as r from {of}),
contexted as (select *, avg(r) over d as market_return_1, avg(case when r > 0 then 1.0::double else 0.0 end) over d as market_breadth_up, r - avg(r) over d as relative_return_1,
  (row_number() over (partition by date order by r, code) - 1) / cast(greatest(1, count(r) over d - 1) as double) as return_rank from returned window d as (partition by date))
"""


def labels(of):
    return f""", fcal as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from {of})),
labelled as (select p.*, c5.date as label_5d_end_date, t5.tri / nullif(p.tri, 0) - 1 as fwd_return_5d, c20.date as label_20d_end_date, t20.tri / nullif(p.tri, 0) - 1 as fwd_return_20d
  from {of} p join fcal c on p.date = c.date left join fcal c5 on c5.pos = c.pos + 5 left join fcal c20 on c20.pos = c.pos + 20
  left join {of} t5 on t5.code = p.code and t5.date = c5.date left join {of} t20 on t20.code = p.code and t20.date = c20.date)
"""


KNOWN = " and ".join(f"{f} is not null" for f in FACTORS)
PANEL = FACTOR + context("factored") + labels("contexted") + f", panel as (select * from labelled where {KNOWN} and fwd_return_5d is not null and fwd_return_20d is not null)"
LONG = PANEL + ", long as (" + " union all ".join(f"select date, code, '{f}' as factor, round({f}, 9) as x, fwd_return_5d as y from panel" for f in FEATURES) + ")"
IC = (
    LONG
    + """, ranked as (select date, factor, rank() over (partition by date, factor order by x) - 1 + (count(*) over (partition by date, factor, x) - 1) / 2.0 as rx,
  rank() over (partition by date, factor order by y) - 1 + (count(*) over (partition by date, factor, y) - 1) / 2.0 as ry from long),
ic as (select * from (select date, factor, count(*) as n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as ic from ranked group by all) where n >= 3 and ic is not null)
"""
)
SUMMARY = "count(*) as days, avg(ic) as mean_ic, median(ic) as median_ic, stddev_pop(ic) as std_ic, case when stddev_pop(ic) > 1e-20 then avg(ic) / stddev_pop(ic) end as ir, case when stddev_pop(ic) > 1e-20 then avg(ic) / stddev_pop(ic) end * sqrt(252) as annual_ir, avg(case when ic > 1e-12 then 1.0::double else 0.0 end) as positive_ratio, avg(abs(ic)) as mean_abs_ic"
SUMMED = ["mean_ic", "median_ic", "std_ic", "ir", "annual_ir", "positive_ratio", "mean_abs_ic"]

MONEY = "cast({} as decimal(18,4))"
LEDGER = (
    BARS
    + """, listing as (select code, min(date) as listing_date from bars group by code),
grid as (select c.date, l.code, greatest(c.pos - cl.pos + 1, 0) as age from cal c cross join listing l join cal cl on cl.date = l.listing_date),
known as (select *, case day(date) when 13 then 'missing' when 14 then 'invalid_format' else 'complete' end as quality from bars),
traded as (select g.*, cast(b.high as decimal(18,4)) as h, cast(b.low as decimal(18,4)) as l, cast(b.preclose as decimal(18,4)) as p,
  case when g.age <= 0 then 'not_listed' when b.quality is null then 'no_record' when b.quality = 'missing' then case when tradestatus = 0 then 'suspended' else 'missing_data' end
    when b.quality = 'invalid_format' then 'invalid_data' when tradestatus = 0 then 'suspended' when tradestatus = 1 then 'trading' else 'unknown' end as trading_status
  from grid g left join known b on b.date = g.date and b.code = g.code),
limited as (select *, case when age <= 0 then 'not_listed' when age < 250 then 'listed_less_than_one_year' else 'listed_at_least_one_year' end as listing_status,
  case when trading_status <> 'trading' then 'not_applicable' when age <= 1 then 'none' when h >= round(p * 1.10, 2) - 0.0001 and l <= round(p * 0.90, 2) + 0.0001 then 'limit_up_and_down'
    when h >= round(p * 1.10, 2) - 0.0001 then 'limit_up' when l <= round(p * 0.90, 2) + 0.0001 then 'limit_down' else 'none' end as price_limit_status from traded),
ledger as (select *, case when age <= 0 then 'not_listed' when trading_status in ('suspended', 'missing_data', 'invalid_data', 'no_record') then trading_status when trading_status = 'unknown' then 'unknown'
    when age < 250 then 'listed_less_than_one_year' when price_limit_status in ('limit_up', 'limit_down', 'limit_up_and_down') then price_limit_status else 'normal' end as security_status from limited)
"""
)
EVENTS = (
    BARS
    + """, counted as (select code, cast(date_trunc('month', date) + interval 1 month as date) as snapshot_date, count(*) as n from lines group by all),
member as (select snapshot_date, code from counted where n % 3 <> 0),
following as (select snapshot_date, lead(snapshot_date) over (order by snapshot_date) as next from (select distinct snapshot_date from member)),
events as (select snapshot_date, snapshot_date as effective_date, code, 'member' as event_type from member union all
  select f.next, f.next, m.code, 'removed' from member m join following f on f.snapshot_date = m.snapshot_date where f.next is not null and not exists (select 1 from member o where o.snapshot_date = f.next and o.code = m.code))
"""
)


def _fitted(f):
    c = f"least(greatest({f}, q.{f}_low), q.{f}_high)"
    return f"avg({c}) as {f}_mean, stddev_pop({c}) as {f}_scale, any_value(q.{f}_median) as {f}_median, any_value(q.{f}_low) as {f}_low, any_value(q.{f}_high) as {f}_high"


FITTED = (
    PANEL
    + ", q as (select " + ", ".join(f"quantile_cont({f}, 0.5) as {f}_median, quantile_cont({f}, 0.01) as {f}_low, quantile_cont({f}, 0.99) as {f}_high" for f in FEATURES) + " from panel)"
    + ", fit as (select " + ", ".join(map(_fitted, FEATURES)) + " from panel cross join q)"
)
STANDARD = (
    FITTED
    + ", std as (select p.code, p.date, fwd_return_5d - avg(fwd_return_5d) over (partition by p.date) as y, "
    + ", ".join(f"(least(greatest(p.{f}, {f}_low), {f}_high) - {f}_mean) / {f}_scale as {f}" for f in FEATURES)
    + " from panel p cross join fit)"
)
PROBABILITY = PANEL + ", prob as (select date, code, return_rank as score, cast(fwd_return_5d > 0 as bigint) as up, fwd_return_5d as y from panel)"
FOLDS = PANEL + """, days as (select list(date order by date) as l, count(*) as n from (select distinct date from panel)),
folds as (select f + 1 as fold, l[cast(floor(n * (0.55::double + f * 0.10::double)) as bigint) + 1] as start_date, l[least(cast(floor(n * (0.55::double + f * 0.10::double + 0.10::double)) as bigint), n)] as end_date
  from days, (select unnest([0, 1, 2, 3]) as f)),
walk as (select w.*, fold, start_date, end_date, case when date between start_date and end_date then 'test' else 'train' end as role from panel w join folds
  on date between start_date and end_date or (date < start_date and label_5d_end_date < start_date))
"""


def _pairs():
    ranks = ", ".join(f"rank() over (partition by date order by {f}) - 1 + (count(*) over (partition by date, {f}) - 1) / 2.0 as {f}" for f in FEATURES)
    near = ", ".join(f"round({f}, 9) as {f}" for f in FEATURES)
    daily = " union all ".join(
        f"select date, '{a}' as factor_a, '{b}' as factor_b, covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) as r from rk group by date having count(*) >= 3" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]
    )
    return f"with {PANEL}, nr as (select date, {near} from panel), rk as (select date, {ranks} from nr), pr as ({daily}) select factor_a, factor_b, count(*) as days, round(avg(r), 6) + 0.0 as mean_r, round(avg(abs(r)), 6) + 0.0 as mean_abs_r, round(avg(case when r > 1e-12 then 1.0::double else 0.0 end), 6) + 0.0 as positive_ratio from pr where r is not null group by all"


def _hit(c, t):
    return f"cast(sum(case when up = {c} and (score >= {t}) = ({c} = 1) then 1 else 0 end) as double) / nullif(sum(case when up = {c} then 1 else 0 end), 0)"


def _factors(*names):
    return f"with {FACTOR} select code, date, {r(names)} from factored"


ORACLES = {
    "q01_bars": f"with {BARS} select code, date, open, high, low, close, volume, amount, turn, preclose, tradestatus from bars",
    "q02_normalize_dates": "select o_orderkey, case when o_orderkey % 6 < 4 then cast(o_orderdate as date) end as date, o_orderkey % 6 = 5 as missing, case when o_orderkey % 6 = 0 then cast(o_orderdate as date) end as strict from orders",
    "q03_normalize_codes": "select s_suppkey, case s_suppkey % 5 when 0 then 'sh.' || k when 1 then 'sz.' || k when 2 then 'bj.' || k end as code, case s_suppkey % 5 when 1 then 0.05::double when 2 then 0.30::double else 0.10::double end as rate from (select *, lpad(cast(s_suppkey as varchar), 6, '0') as k from supplier)",
    "q04_decimal_round": "select o_orderkey, cast(round(p, 1) as double) as price, case when p = floor(p) then cast(p as bigint) else -1 end as whole, cast(p as double) as number from (select o_orderkey, case when o_orderkey % 7 <> 0 then cast(o_totalprice as decimal(18,2)) end as p from orders)",
    "q05_reject_reasons": """with t as (select *, l_orderkey % 17 as kind, cast(l_shipdate as date) as d from lineitem join part on l_partkey = p_partkey),
        n as (select *, row_number() over (partition by d, p_brand order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as place from t where kind not in (1, 2))
        select reason, count(*) as n from (select 'invalid_identity' as reason from t where kind in (1, 2) union all
        select case when place > 1 then 'duplicate' when kind in (3, 5) then 'missing' when kind = 4 then 'invalid_format' else 'complete' end from n) group by reason""",
    "q06_dedupe_keep_first": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1",
    "q07_calendar": f"with {BARS} select 'session' as kind, date, pos from cal union all select 'monday', cast(d as date), -1 from (select unnest(generate_series((select min(date) from cal)::timestamp, (select max(date) from cal)::timestamp, interval 1 day)) as d) where isodow(d) = 1",
    "q08_listing_age": f"with {BARS}, f as (select code, min(date) as listing_date from bars group by code) select b.code, b.date, listing_date, c.pos - l.pos + 1 as age, case when c.pos - l.pos + 1 < 250 then 'listed_less_than_one_year' else 'listed_at_least_one_year' end as listing_status from bars b join f using (code) join cal c on c.date = b.date join cal l on l.date = listing_date",
    "q09_price_limit": f"""with {BARS}, m as (select *, {MONEY.format('high')} as h, {MONEY.format('low')} as l, {MONEY.format('preclose')} as p, case when code = 'Brand#11' then 0.05::decimal(3,2) else 0.10::decimal(3,2) end as rate from bars),
        u as (select *, h >= round(p * (1 + rate), 2) - 0.0001 as up, l <= round(p * (1 - rate), 2) + 0.0001 as down from m)
        select code, date, case when tradestatus <> 1 then 'not_applicable' when up and down then 'limit_up_and_down' when up then 'limit_up' when down then 'limit_down' else 'none' end as price_limit_status from u""",
    "q10_status_ledger": f"with {LEDGER} select date, code, age, listing_status, trading_status, price_limit_status, security_status from ledger",
    "q11_clean_daily": f"with {LEDGER} select date, code, close, age, security_status from ledger join known using (date, code) where quality = 'complete' and age >= 250",
    "q12_status_counts": f"with {LEDGER} " + " union all ".join(f"select '{k}' as kind, {k} as status, count(*) as n from ledger group by {k}" for k in ("listing_status", "trading_status", "security_status")),
    "q13_join_names": f"with {BARS}, names as (select p_brand as code, max(p_name) as code_name from part group by p_brand) select code, date, volume, code_name from bars left join names using (code)",
    "q14_membership_events": f"with {EVENTS} select * from events",
    "q15_membership_asof": f"with {EVENTS}, e as (select b.code, b.date, snapshot_date, effective_date, event_type from bars b join events e on e.code = b.code and snapshot_date <= b.date qualify row_number() over (partition by b.code, b.date order by snapshot_date desc, effective_date desc, event_type desc) = 1) select * from e where event_type = 'member'",
    "q16_split": f"""with {BARS}, n as (select count(*) as n from cal), s as (select date, case when pos < floor(n * 0.70) + a then 'train' when pos < floor(n * 0.70) + floor(n * 0.10) + a + b then 'validation' when pos < floor(n * 0.70) + 2 * floor(n * 0.10) + a + b + c then 'test' else 'final_oos' end as split from cal, n,
        (select case when k >= 1 and rt >= rv then 1 else (case when k >= 4 then 1 else 0 end) end as a, case when rt >= rv then (case when k >= 2 then 1 else 0 end) else (case when k >= 1 then 1 else 0 end) end as b, case when rt >= rv then (case when k >= 3 then 1 else 0 end) else (case when k >= 2 then 1 else 0 end) end as c
         from (select n - floor(n * 0.70) - 3 * floor(n * 0.10) as k, n * 0.70 - floor(n * 0.70) as rt, n * 0.10 - floor(n * 0.10) as rv from n)))
        select split, count(distinct date) as dates, min(date) as first_date, max(date) as last_date, count(*) as n from bars join s using (date) group by split""",
    "q17_walk_forward": f"with {FOLDS} select cast(fold as bigint) as fold, start_date, end_date, role, count(*) as n from walk group by all",
    "q18_tri": f"with {TRI}, a as (select code, cast(sum(case when lagged > 0 and abs(preclose / lagged - 1) > 1e-6 then 1 else 0 end) as bigint) as n_events from (select *, lag(close) over (partition by code order by date) as lagged from bars) group by code) select code, date, rn, {r(['tri'], 2)}, n_events from tri join a using (code)",
    "q19_momentum": _factors("return_1", "momentum_5", "momentum_20", "momentum_60"),
    "q20_volatility": _factors("volatility_20", "volatility_60"),
    "q21_sma_volume_ratios": _factors("sma_ratio_5_20", "sma_ratio_20_60", "volume_ratio_5_20", "amount_ratio_5_20", "turnover_mean_20"),
    "q22_bar_shape": _factors("intraday_range", "close_location", "open_gap"),
    "q23_amihud_rsi": _factors("amihud_20", "rsi_14"),
    "q24_context": f"with {BARS}{context('bars')} select code, date, {r(CONTEXT)} from contexted",
    "q25_factor_panel": f"with {FACTOR}{context('factored')} select code, date, {r(FACTORS + CONTEXT)} from contexted where {KNOWN}",
    "q26_forward_labels": f"with {TRI}{labels('tri')} select code, date, label_5d_end_date, label_20d_end_date, {r(['fwd_return_5d', 'fwd_return_20d'])} from labelled",
    "q27_drop_reasons": f"with {FACTOR}{labels('factored')} select case when not ({KNOWN}) then 'feature_warmup' when label_5d_end_date is null then 'label_5d_outside' when fwd_return_5d is null then case when tri = 0 then 'invalid_label_base_price' else 'label_5d_missing' end when label_20d_end_date is null then 'label_20d_outside' when fwd_return_20d is null then case when tri = 0 then 'invalid_label_base_price' else 'label_20d_missing' end else 'kept' end as reason, count(*) as n from labelled group by reason",
    "q28_preprocess_params": f"with {FITTED} " + " union all ".join(f"select '{f}' as factor, round({f}_median, 6) + 0.0 as median, round({f}_low, 6) + 0.0 as low, round({f}_high, 6) + 0.0 as high, round({f}_mean, 6) + 0.0 as mean, round({f}_scale, 6) + 0.0 as scale from fit" for f in FEATURES),
    "q29_standardized": f"with {STANDARD} select code, date, {r(['y', *FEATURES])} from std",
    "q30_rank_ic_daily": f"with {IC} select date, factor, n, {r(['ic'])} from ic",
    "q31_ic_summary": f"with {IC}, s as (select factor, {SUMMARY} from ic group by factor) select factor, days, {r(SUMMED)} from s",
    "q32_ic_yearly": f"with {IC}, s as (select factor, year(date) as year, {SUMMARY} from ic group by all) select factor, year, days, {r(SUMMED)} from s",
    "q33_newey_west": f"""with {IC}, e as (select *, row_number() over (partition by factor order by date) as i, ic - avg(ic) over (partition by factor) as e, count(*) over (partition by factor) as m from ic),
        s as (select a.factor, a.m, sum(case when a.i = b.i then 1.0 else 2 * (1 - (a.i - b.i) / (least(4, a.m - 1) + 1.0)) end * a.e * b.e) / a.m as s from e a join e b on a.factor = b.factor and a.i >= b.i and a.i - b.i <= least(4, a.m - 1) group by a.factor, a.m),
        t as (select factor, avg(ic) as mean_ic from ic group by factor) select factor, m as days, round(mean_ic, 6) + 0.0 as mean_ic, round(case when m >= 2 and s / m > 1e-20 then mean_ic / sqrt(s / m) end, 6) + 0.0 as t_stat from s join t using (factor)""",
    "q34_factor_pairs": _pairs(),
    "q35_stability": f"""with {IC}, s as (select factor, avg(case when date < date '2000-01-01' then ic end) as train_ic, avg(case when date >= date '2000-01-01' then ic end) as validation_ic from ic group by factor)
        select factor, {r(['train_ic', 'validation_ic'])}, train_ic * validation_ic > 0 as consistent, row_number() over (order by round(abs(validation_ic), 12) desc, factor) as place from s where train_ic is not null and validation_ic is not null""",
    "q36_gram": f"with {STANDARD} " + " union all ".join([f"select '{a}' as a, '{b}' as b, round(avg({a} * {b}), 5) + 0.0 as value from std" for a in FEATURES for b in [*FEATURES, "y"]]),
    "q37_composite_score": f"with {STANDARD}, sg as (select {', '.join(f'sign(sum({f} * y)) as s_{f}' for f in VARIED)} from std) select code, date, round(({' + '.join(f's_{f} * {f} / {len(VARIED)}' for f in VARIED)}) / sqrt({len(VARIED)}), 5) + 0.0 as score from std cross join sg",
    "q40_knn": """with n as (select q.vec_id as query_id, t.vec_id as train_id, t.label as y, list_sum(list_transform(list_zip(q.embedding::double[], t.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d2 from embeddings q, embeddings t where q.vec_id % 100 = 0 and t.vec_id <> q.vec_id),
        k as (select *, row_number() over (partition by query_id order by d2, train_id) as place from n qualify place <= 5),
        p as (select query_id, coalesce(avg(case when d2 <= 1e-24 then y end), sum(y / sqrt(greatest(d2, 1e-24))) / sum(1 / sqrt(greatest(d2, 1e-24)))) as prediction from k group by query_id)
        select query_id, train_id, place, round(prediction, 5) + 0.0 as prediction from k join p using (query_id)""",
    "q42_direction_metrics": f"""with {PROBABILITY}, k as (select *, rank() over (order by score) - 1 + (count(*) over (partition by score) - 1) / 2.0::double as rk from prob)
        select count(*) as n, round(avg(case when (score >= 0.5) = (up = 1) then 1.0::double else 0.0 end), 6) + 0.0 as accuracy, round(({_hit(1, 0.5)} + {_hit(0, 0.5)}) / 2, 6) + 0.0 as balanced, round(avg((score - up) * (score - up)), 6) + 0.0 as brier,
        round((sum(rk * up) - sum(up) * (sum(up) - 1) / 2.0::double) / nullif(sum(up) * sum(1 - up), 0), 6) + 0.0 as auc, cast(sum(up) as bigint) as ups, cast(sum(1 - up) as bigint) as downs from k""",
    "q43_bucket_spread": f"""with {PROBABILITY}, g as (select date, score, avg(y) as m, count(*) as c from prob group by all),
        b as (select *, greatest(1, ceil(sum(c) over (partition by date) * 0.2::double)) as k, coalesce(sum(c) over (partition by date order by score rows between unbounded preceding and 1 preceding), 0) as lo, coalesce(sum(c) over (partition by date order by score desc rows between unbounded preceding and 1 preceding), 0) as hi from g),
        s as (select date, cast(sum(c) as bigint) as n, sum(greatest(0, least(c, k - hi)) * m / k) as top, sum(greatest(0, least(c, k - lo)) * m / k) as bottom from b group by date) select date, n, round(top, 6) + 0.0 as top, round(bottom, 6) + 0.0 as bottom, round(top - bottom, 6) + 0.0 as spread from s""",
    "q44_topk_schedule": f"""with {FACTOR}, sc as (select date, code, -momentum_5 as score from factored where momentum_5 is not null), sd as (select date from (select date, row_number() over (order by date) - 1 as n from (select distinct date from sc)) where n % 5 = 0),
        nx as (select date, lead(date) over (order by date) as execution_date from cal) select sc.date as signal_date, execution_date, code, row_number() over (partition by sc.date order by score desc, code) as place from sc join sd using (date) join nx using (date) where execution_date is not null qualify place <= 5""",
    "q45_tradability": f"with {LEDGER} select date, code, trading_status = 'trading' and price_limit_status <> 'limit_up' as can_buy, trading_status = 'trading' and price_limit_status <> 'limit_down' as can_sell from ledger",
    "q47_nav_metrics": f"""with {BARS}, g as (select date, 1 + avg(close / open - 1) / 1000 as g from bars group by date), nav as (select date, 100.0::double * product(g) over (order by date rows unbounded preceding) as nav from g),
        v as (select *, nav / coalesce(lag(nav) over (order by date), 100.0) - 1 as r, least(nav / greatest(max(nav) over (order by date rows unbounded preceding), 100.0) - 1, 0.0) as dd from nav),
        s as (select 'made' as run_id, count(*) as days, arg_max(nav, date) / 100 - 1 as total_return, pow(arg_max(nav, date) / 100, 252.0::double / count(*)) - 1 as annual_return, stddev_pop(r) as sd, avg(r) as mr, min(dd) as max_drawdown from v)
        select run_id, days, round(total_return, 5) + 0.0 as total_return, round(annual_return, 5) + 0.0 as annual_return, round(sd * sqrt(252), 5) + 0.0 as volatility, round(case when sd > 1e-12 then mr / sd * sqrt(252) end, 5) + 0.0 as sharpe, round(max_drawdown, 5) + 0.0 as max_drawdown, round(case when max_drawdown < -1e-12 then annual_return / abs(max_drawdown) end, 5) + 0.0 as calmar from s""",
    "q48_latest_name": "select p_brand as code, arg_max(p_name, p_partkey) as code_name from part group by p_brand",
    "q49_thresholds": f"""with {FOLDS}, t as (select return_rank as score, cast(fwd_return_5d > 0 as bigint) as up from walk where role = 'test'), m as ("""
    + " union all ".join(f"select {t}::double as threshold, ({_hit(1, t)} + {_hit(0, t)}) / 2 as balanced from t" for t in (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65))
    + ") select threshold, round(balanced, 6) + 0.0 as balanced, row_number() over (order by round(balanced, 9) desc nulls last, threshold) as place from m",
    "q51_portfolio_metrics": f"""with {BARS}, g as (select date, 1 + avg(close / open - 1) / 1000 as g, sum(volume) as v from bars group by date), nav as (select date, 100.0::double * product(g) over (order by date rows unbounded preceding) as nav, v % 50 as gross from g),
        v as (select *, nav / coalesce(lag(nav) over (order by date), 100.0) - 1 as r, least(nav / greatest(max(nav) over (order by date rows unbounded preceding), 100.0) - 1, 0.0) as dd from nav),
        s as (select count(*) as days, arg_max(nav, date) as last, avg(nav) as mn, stddev_pop(r) as sd, avg(r) as mr, min(dd) as dd, sum(gross) as gross, cast(sum(case when day(date) % 5 = 0 then 1 else 0 end) as bigint) as rebalance_count from v),
        m as (select *, pow(last / 100, 252.0::double / days) - 1 as yearly from s)
        select 'made' as run_id, days, round(last / 100 - 1, 5) + 0.0 as total_return, round(yearly, 5) + 0.0 as annual_return, round(sd * sqrt(252), 5) + 0.0 as volatility, round(case when sd > 1e-12 then mr / sd * sqrt(252) end, 5) + 0.0 as sharpe, round(dd, 5) + 0.0 as max_drawdown,
        round(case when dd < -1e-12 then yearly / abs(dd) end, 5) + 0.0 as calmar, 0.5::double as average_exposure, rebalance_count, round(last, 5) + 0.0 as final_nav, days as trade_count, round(gross / mn, 5) + 0.0 as turnover_ratio, round(gross / mn * 252 / days, 5) + 0.0 as annualized_turnover,
        round(gross * 3e-4, 5) + 0.0 as total_commission, round(gross * 5e-4, 5) + 0.0 as total_stamp_tax, round(gross * 1e-3, 5) + 0.0 as total_slippage, round(gross * 1.8e-3, 5) + 0.0 as total_costs, round(gross * 1.8e-3 / mn * 10000, 5) + 0.0 as costs_bps_of_nav from m""",
    "q53_signal_metrics": f"""with {PANEL}, cn as (select *, fwd_return_5d - avg(fwd_return_5d) over (partition by date) as centred from panel),
        lg as (select date, code, c as candidate, case c when 'factor_composite' then momentum_5 when 'reversal' then -momentum_5 else close_location end as score, fwd_return_5d as y, centred from cn, (select unnest(['factor_composite', 'reversal', 'shape']) as c)),
        rk as (select *, rank() over (partition by candidate, date order by score) - 1 + (count(*) over (partition by candidate, date, score) - 1) / 2.0::double as rx, rank() over (partition by candidate, date order by y) - 1 + (count(*) over (partition by candidate, date, y) - 1) / 2.0::double as ry from lg),
        di as (select candidate, date, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) as ic from rk group by all),
        mi as (select candidate, avg(ic) as mean_ic from di where ic is not null group by all),
        gr as (select candidate, date, score, avg(y) as m, count(*) as c from lg group by all),
        bk as (select *, greatest(1, ceil(sum(c) over (partition by candidate, date) * 0.2::double)) as k, coalesce(sum(c) over (partition by candidate, date order by score rows between unbounded preceding and 1 preceding), 0) as lo, coalesce(sum(c) over (partition by candidate, date order by score desc rows between unbounded preceding and 1 preceding), 0) as hi from gr),
        sd as (select candidate, date, sum(c) as n, sum(greatest(0, least(c, k - hi)) * m / k) as top, sum(greatest(0, least(c, k - lo)) * m / k) as bottom from bk group by all),
        ms as (select candidate, count(*) as trading_dates, cast(sum(n) as bigint) as rows, avg(top - bottom) * 1e4 as spread, avg(case when top - bottom > 0 then 1.0::double else 0.0 end) as positive_spread_ratio, avg(top) * 1e4 as top_bps, avg(bottom) * 1e4 as bottom_bps from sd group by all),
        er as (select candidate, avg(abs(centred - score)) * 1e4 as mae_bps, sqrt(avg((centred - score) * (centred - score))) * 1e4 as rmse_bps from lg group by all),
        j as (select * from ms join mi using (candidate) join er using (candidate)), bs as (select mean_ic as bi, spread as bsp from j where candidate = 'factor_composite')
        select candidate, round(mean_ic, 5) + 0.0 as mean_daily_rank_ic, round(spread, 5) + 0.0 as mean_spread_bps, round(mean_ic - bi, 5) + 0.0 as more_ic, round(spread - bsp, 5) + 0.0 as more_spread,
        candidate <> 'factor_composite' and mean_ic > 0 and spread > 0 and mean_ic > bi and spread > bsp as advances, row_number() over (order by mean_ic desc nulls last, spread desc nulls last, candidate) as place,
        trading_dates, rows, round(positive_spread_ratio, 5) + 0.0 as positive_spread_ratio, round(top_bps, 5) + 0.0 as top_bps, round(bottom_bps, 5) + 0.0 as bottom_bps, round(mae_bps, 5) + 0.0 as mae_bps, round(rmse_bps, 5) + 0.0 as rmse_bps from j cross join bs""",
    "q54_direction_summary": f"""with {PROBABILITY}, dy as (select date, avg(case when (score >= 0.5) = (up = 1) then 1.0::double else 0.0 end) as a, {_hit(1, 0.5)} as s, {_hit(0, 0.5)} as t from prob group by date),
        dm as (select count(*) as trading_dates, avg(a) as mean_daily_accuracy, avg((s + t) / 2) as mean_daily_balanced from dy),
        tt as (select count(*) as n, avg(case when (score >= 0.5) = (up = 1) then 1.0::double else 0.0 end) as accuracy, greatest(avg(up), 1 - avg(up)) as majority_accuracy, {_hit(1, 0.5)} as sensitivity, {_hit(0, 0.5)} as specificity, avg((score - up) * (score - up)) as brier,
          avg(case when score >= 0.5 then 1.0::double else 0.0 end) as predicted_up_rate, avg(up) as actual_up_rate from prob)
        select n, {r(['accuracy', 'majority_accuracy', 'sensitivity', 'specificity', 'brier', 'predicted_up_rate', 'actual_up_rate'])}, round((sensitivity + specificity) / 2, 6) + 0.0 as balanced, round(accuracy - majority_accuracy, 6) + 0.0 as accuracy_vs_majority, trading_dates, {r(['mean_daily_accuracy', 'mean_daily_balanced'])} from tt cross join dm""",
    "q55_membership_audit": f"""with {EVENTS}, e as (select b.code, b.date, coalesce(event_type, 'before_first_event') as state from bars b left join events e on e.code = b.code and snapshot_date <= b.date qualify row_number() over (partition by b.code, b.date order by snapshot_date desc nulls last, effective_date desc, event_type desc) = 1)
        select state, count(*) as n, count(distinct code) as codes from e group by state""",
    "q56_daily_rows": f"""with {BARS} select date, 'sh.' || lpad(regexp_extract(code, '(\\d+)', 1), 6, '0') as code, floor(open) + 0.25::double as open, cast(volume as bigint) as volume, 'J66' as industry_code, 'none' as adjustment from bars where day(date) not in (3, 4, 5, 6)""",
}
