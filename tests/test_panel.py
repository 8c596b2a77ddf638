import datetime as dt
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.operators import backtest as B
from tidemark.operators import factors as X
from tidemark.operators import models as M
from tidemark.operators import panel as P
from tidemark.operators import selection as C
from tidemark.operators import stability as S
from tidemark.sources import fixtures as T

DAY = dt.date(2020, 1, 1)


def days(n, step=1):
    return [DAY + dt.timedelta(days=i * step) for i in range(n)]


def bar_rows(n, late=1.0, code="sh.600000"):
    out = []
    for i, d in enumerate(days(n)):
        m = late if i > 70 else 1.0
        close = (10 + 0.1 * i) * m
        out.append((d, code, close * 0.999, close * 1.01, close * 0.99, close, close / 1.001, 1000.0 + i, close * (1000 + i), 0.5 + i / 1000, 1))
    return out


BAR = "date date, code string, open double, high double, low double, close double, preclose double, volume double, amount double, turn double, tradestatus int"


def test_normalisers(spark):
    rows = spark.createDataFrame([("2020-2-3", " SH600000 ", "1,234.55", "NaN"), ("20200230", "us.1", "1e400", None), ("2020.02.03", "bj.430001", "12x", " n/a ")], "d string, c string, n string, m string")
    got = rows.select(N.normalize_date(F.col("d")), N.normalize_code(F.col("c")), N.normalize_decimal(F.col("n"), 1).cast("string"), N.is_missing(F.col("m")), N.parse_number(F.col("n"))).collect()
    assert tuple(got[0]) == (dt.date(2020, 2, 3), "sh.600000", "1234.6", True, 1234.55)
    assert tuple(got[1]) == (None, None, None, True, None)
    assert tuple(got[2]) == (dt.date(2020, 2, 3), "bj.430001", None, True, None)


def test_price_limit_rounds_half_up(spark):
    row = spark.sql("select cast('11.06' as decimal(18,4)) h, cast('10.00' as decimal(18,4)) l, cast('10.05' as decimal(18,4)) p")
    status = P.price_limit_status(F.lit(True), F.lit(300), F.col("h"), F.col("l"), F.col("p"), N.limit_rate(F.lit("sh.600000"), F.lit(False)))
    assert row.select(status).first()[0] == "limit_up"


def test_ledger_is_dense_and_statuses(spark):
    rows = [(d, c, 10.0, 10.0, 10.0, q, 1) for d in days(3) for c, q in (("a", "complete"), ("b", "missing"))][:-1]
    bars = spark.createDataFrame(rows, "date date, code string, high double, low double, preclose double, quality string, tradestatus int")
    got = {(r.date, r.code): r for r in P.status_ledger(bars, least=2).collect()}
    assert len(got) == 6
    assert got[days(3)[2], "b"].trading_status == "no_record"
    assert got[days(3)[0], "b"].trading_status == "missing_data"
    assert got[days(3)[0], "a"].security_status == "listed_less_than_one_year"


def test_allocation():
    assert P.allocate(1450, ["0.70", "0.10", "0.10", "0.10"]) == [1015, 145, 145, 145]
    with pytest.raises(ValueError):
        P.allocate(2, ["0.70", "0.10", "0.10", "0.10"])


def test_mondays(spark):
    got = spark.sql("select date'2020-01-01' a, date'2020-01-20' b").select(P.mondays(F.col("a"), F.col("b"))).first()[0]
    assert got == [dt.date(2020, 1, 6), dt.date(2020, 1, 13), dt.date(2020, 1, 20)]


def test_membership_exit_and_empty_snapshot(spark):
    d = dt.date
    shots = spark.createDataFrame([(d(2020, 1, 6), d(2020, 1, 6), "a"), (d(2020, 1, 6), d(2020, 1, 6), "b"), (d(2020, 1, 13), d(2020, 1, 13), "a")], "snapshot_date date, effective_date date, code string")
    rows = spark.createDataFrame([(c, x) for c in "ab" for x in (d(2020, 1, 1), d(2020, 1, 6), d(2020, 1, 20))], "code string, date date")
    got = {(r.code, r.date) for r in P.point_in_time_panel(rows, P.membership_events(shots)).collect()}
    assert got == {("a", d(2020, 1, 6)), ("a", d(2020, 1, 20)), ("b", d(2020, 1, 6))}
    manifest = spark.createDataFrame([(d(2020, 1, 15),)], "snapshot_date date")
    got = {(r.code, r.date) for r in P.point_in_time_panel(rows, P.membership_events(shots, manifest)).collect()}
    assert ("a", d(2020, 1, 20)) not in got
    with pytest.raises(ValueError):
        P.check_events(shots.withColumn("effective_date", F.date_add("snapshot_date", 1)))


def test_total_return_removes_dividend(spark):
    rows = spark.createDataFrame([(days(2)[0], "a", 10.0, 10.0), (days(2)[1], "a", 9.5, 9.0)], "date date, code string, close double, preclose double")
    tri = [r.tri for r in X.total_return(rows).orderBy("date").collect()]
    assert tri == [1.0, 9.5 / 9.0]


def test_factors_do_not_look_ahead(spark):
    one, two = (X.add_factors(X.total_return(spark.createDataFrame(bar_rows(90, m), BAR))).filter(F.col("date") == days(90)[70]).select(*X.FACTORS).first() for m in (1.0, 100.0))
    assert one == two and None not in one


def test_labels_follow_the_calendar(spark):
    panel = X.labelled_panel(spark.createDataFrame(bar_rows(100), BAR)).orderBy("date").collect()
    at = days(100)
    assert len(panel) == 20
    assert (panel[0].label_5d_end_date, panel[0].label_20d_end_date, panel[-1].label_20d_end_date) == (at[65], at[80], at[99])


def test_rsi_edges(spark):
    flat = [(d, "a", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1) for d in days(20)]
    rising = [(d, "b", 1.0, 1.0, 1.0, 2.0**i, 2.0 ** (i - 1), 1.0, 1.0, 1.0, 1) for i, d in enumerate(days(20))]
    rows = X.add_factors(X.total_return(spark.createDataFrame(flat + rising, BAR))).filter(F.col("date") == days(20)[-1])
    assert {r.code: r.rsi_14 for r in rows.collect()} == {"a": 50.0, "b": 100.0}


def test_context_defaults_and_rank(spark):
    rows = spark.createDataFrame([(DAY, "a", 11.0, 10.0), (DAY, "b", 9.0, 10.0), (DAY, "c", 9.0, None)], "date date, code string, close double, preclose double")
    got = {r.code: r for r in X.add_context(rows).collect()}
    assert abs(got["a"].market_return_1) < 1e-12 and got["c"].market_breadth_up == 0.5


def test_rank_ic_pairs_and_small_sections(spark):
    rows = spark.createDataFrame([(DAY, f"c{i}", float(i), float(6 - i), float(i)) for i in range(1, 6)] + [(days(2)[1], "c1", 1.0, 2.0, 3.0), (days(2)[1], "c2", 2.0, 1.0, 4.0)], "date date, code string, a double, b double, y double")
    got = {r.factor: r.ic for r in S.daily_ic(rows, ["a", "b"], "y").collect()}
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(-1)
    assert S.factor_pairs(rows, ["a", "b"]).first().mean_r == pytest.approx(-1)


def test_newey_west_without_lag(spark):
    ic = spark.createDataFrame([(d, "f", float(i + 1)) for i, d in enumerate(days(5))], "date date, factor string, ic double")
    assert S.newey_west(ic, 0).first().t_stat == pytest.approx(3 / (2 / 5) ** 0.5)


def test_bucket_ties_and_auc(spark):
    rows = spark.createDataFrame([(DAY, 1.0 if i < 3 else 2.0, float(i)) for i in range(10)], "date date, score double, y double")
    got = S.bucket_means(rows).first()
    assert got.bottom == pytest.approx(1.0) and got.top == pytest.approx(6.0)
    assert S.auc(spark.createDataFrame([(0.5, 0), (0.5, 1)], "score double, up int")).first().auc == 0.5


def test_linear_models_recover_signal():
    i = np.arange(120)[:, None]
    f = np.arange(6)[None, :]
    x = np.sin(i * (f + 1) * 0.13) + np.cos(i * (f + 3) * 0.07)
    y = 0.7 * x[:, 0] - 0.3 * x[:, 1]
    g, c = x.T @ x / 120, x.T @ y / 120
    for b in (M.ridge(g, c, 1e-8), M.elastic_net(g, c, 1e-8, 0.5)):
        assert np.corrcoef(x @ b, y)[0, 1] > 0.999


def test_folds_are_purged(spark):
    rows = spark.createDataFrame([(d, d + dt.timedelta(days=5)) for d in days(100)], "date date, end date")
    got = P.walk_forward(rows, "end").collect()
    assert {r.fold for r in got} == {1, 2, 3, 4}
    assert all(r.end < r.start_date if r.role == "train" else r.date >= r.start_date for r in got)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal(3000), rng.integers(0, 4, 3000).astype(float)
    rows = spark.createDataFrame([(float(x), None if i % 7 == 0 else float(y), None) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, c double")
    got = M.exact_quantiles(rows, ["a", "b", "c"], (0.5, 0.01, 0.99), accuracy=50)
    kept = b[np.arange(3000) % 7 != 0]
    assert got["a"] == pytest.approx(np.quantile(a, [0.5, 0.01, 0.99])) and got["b"] == pytest.approx(np.quantile(kept, [0.5, 0.01, 0.99])) and all(map(math.isnan, got["c"]))


def test_closed_forms_of_linear_models():
    g, c = np.diag([2.0, 1.0, 0.5]), np.array([1.0, -0.3, 0.05])
    assert M.ridge(g, c, 0.1) == pytest.approx(c / (np.diag(g) + 0.1))
    # without correlations the net is soft thresholding
    assert M.elastic_net(g, c, 0.2, 0.5) == pytest.approx(np.sign(c) * np.maximum(np.abs(c) - 0.1, 0) / (np.diag(g) + 0.1))


def test_logistic_meets_its_conditions(spark):
    """At the optimum the gradient of every coefficient is l2 times it, and the mean probability is the mean label."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 2))
    y = (x @ [1.0, -0.5] + rng.logistic(size=400) > 0.3).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(u)) for (a, b), u in zip(x, y, strict=True)], "a double, b double, up int")
    for l2, (intercept, b) in zip((1e-2, 1.0), M.logistics(rows, ["a", "b"], "up", [1e-2, 1.0]), strict=True):
        p = 1 / (1 + np.exp(-(x @ b + intercept)))
        assert p.mean() == pytest.approx(y.mean(), abs=1e-4) and (y - p) @ x / 400 == pytest.approx(l2 * b, abs=1e-4)
        assert M.logistic(rows, ["a", "b"], "up", l2)[1] == pytest.approx(b)


def test_normal_p_values(spark):
    rows = spark.createDataFrame([(0.0,), (-1.959963984540054,), (3.0,), (None,)], "t double")
    assert [r[0] for r in rows.select(S.normal_p("t")).collect()] == [1.0, pytest.approx(0.05), pytest.approx(0.0026997960632601866), None]


def test_sigmoid_and_lots(spark):
    got = spark.createDataFrame([(0.0, 1234.0), (800.0, -5.0), (-800.0, 99.0)], "x double, n double").select(N.sigmoid(F.col("x")), N.floor_to_lot(F.col("n"), 100)).collect()
    assert [tuple(r) for r in got] == [(0.5, 1200), (pytest.approx(1.0), 0), (pytest.approx(0.0), 0)]


def selection_rows(spark, n=60, codes=12):
    """Targets that follow feature a, a little of b, and noise."""
    rng = np.random.default_rng(7)
    rows = []
    for i, date in enumerate(days(n)):
        for c in range(codes):
            a, b = rng.standard_normal(2)
            rows.append((date, f"c{c}", float(a), float(b), float(0.02 * a + 0.004 * b + 0.01 * rng.standard_normal()), date + dt.timedelta(days=2)))
    return spark.createDataFrame(rows, "date date, code string, a double, b double, target double, label_end date")


def test_selection_over_folds(spark):
    """Out-of-fold scores and their metrics against the same steps in numpy, and the choice, the final fit and the gate."""
    rows = selection_rows(spark)
    walk = C.centred(P.walk_forward(rows, "label_end"), "target").persist()
    scores = C.candidates(walk, ["a", "b"], ("factor_composite", "ridge", "knn")).persist()
    table = walk.toPandas()
    got = scores.toPandas().set_index(["candidate", "fold", "date", "code"])["score"]
    for fold in (1, 4):
        own = table[table.fold == fold]
        train, test = own[own.role == "train"], own[own.role == "test"]
        x = train[["a", "b"]].to_numpy()
        low, high, middle = (np.quantile(x, q, axis=0) for q in (0.01, 0.99, 0.5))
        clipped = np.clip(x, low, high)
        z = lambda v: (np.clip(v, low, high) - clipped.mean(axis=0)) / clipped.std(axis=0)
        t = np.clip(train.centred.to_numpy(), *np.quantile(train.centred, [0.01, 0.99]))
        mean, scale = t.mean(), t.std()
        y, x, new = (t - mean) / scale, z(x), z(test[["a", "b"]].to_numpy())
        ridge = np.linalg.solve(x.T @ x / len(x) + 0.01 * np.eye(2), x.T @ y / len(x))
        near = [np.argsort(((x - v) ** 2).sum(axis=1))[:15] for v in new]
        weights = [1 / np.sqrt(((x[k] - v) ** 2).sum(axis=1)) for k, v in zip(near, new, strict=True)]
        want = {
            "factor_composite": (new * np.sign(x.T @ y)).sum(axis=1) / 2 * scale / 2**0.5, "ridge_alpha_0.01": new @ ridge * scale + mean,
            "knn_k_15": np.array([w @ y[k] / w.sum() for k, w in zip(near, weights, strict=True)]) * scale + mean,
        }
        for name, values in want.items():
            assert [got[name, fold, d, c] for d, c in zip(test.date, test.code, strict=True)] == pytest.approx(list(values), abs=1e-9)
    metrics = S.score_metrics(scores, ["candidate"], "centred").persist()
    one = scores.filter("candidate = 'ridge_alpha_0.01'").toPandas()
    ranks = one.groupby("date")[["score", "y"]].rank()
    ic = [ranks.loc[i].score.corr(ranks.loc[i].y) for i in one.groupby("date").groups.values()]
    r = metrics.filter("candidate = 'ridge_alpha_0.01'").first()
    assert r.mean_daily_rank_ic == pytest.approx(np.mean(ic)) and r.daily_rank_ic_std == pytest.approx(np.std(ic))
    assert r.mae_bps == pytest.approx((one.centred - one.score).abs().mean() * 1e4) and r.rows == len(one)
    chosen = {x.family: x.candidate for x in C.select_models(metrics).collect()}
    best = max((m for m in metrics.collect() if m.candidate.startswith("ridge")), key=lambda m: (m.mean_daily_rank_ic, m.mean_spread_bps))
    assert set(chosen) == {"ridge", "knn"} and metrics.filter(F.col("candidate") == chosen["ridge"]).first().mean_daily_rank_ic == best.mean_daily_rank_ic
    cut = days(60)[45]
    train, validation = (C.centred(rows.filter(x), "target") for x in (F.col("date") < cut, F.col("date") >= cut))
    final = S.score_metrics(C.validate(train, validation, ["a", "b"], chosen, ("factor_composite", "ridge", "knn")), ["candidate"], "centred")
    gated = C.gate(final).persist()
    by = {x.candidate: x for x in gated.collect()}
    assert set(by) == {"factor_composite", *chosen.values()} and not by["factor_composite"].advances and by["factor_composite"].more_ic == 0
    assert all(x.advances == (x.candidate != "factor_composite" and min(x.mean_daily_rank_ic, x.mean_spread_bps, x.more_ic, x.more_spread) > 0) for x in by.values())
    assert C.recommendation(gated, 5).startswith("5d: ")


def test_direction_selection(spark):
    walk = C.centred(P.walk_forward(selection_rows(spark, 40, 6), "label_end"), "target").persist()
    probabilities = C.direction_candidates(walk, ["a", "b"], [1e-2, 1.0]).persist()
    got = C.direction_table(probabilities, [0.4, 0.5], [1e-2, 1.0]).collect()
    rows = probabilities.toPandas()
    for r in got:
        own = rows[rows.l2 == r.l2]
        said, up = own.score >= r.threshold, own.up == 1
        assert r.balanced == pytest.approx(((said & up).sum() / up.sum() + (~said & ~up).sum() / (~up).sum()) / 2)
        assert r.brier == pytest.approx(((own.score - own.up) ** 2).mean())
        ranks = own.score.rank()
        assert r.auc == pytest.approx((ranks[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum()))
    order = sorted(got, key=lambda r: (-r.balanced, -r.auc, r.brier))
    assert len(got) == 4 and {r.place for r in got} == {1, 2, 3, 4} and next(r for r in got if r.place == 1).balanced == order[0].balanced


def test_history_and_drop_reasons(spark):
    at = days(100)
    history = X.add_labels(X.add_factors(X.total_return(spark.createDataFrame(bar_rows(100), BAR))))
    wanted = spark.createDataFrame([(d, "sh.600000") for d in at] + [(at[70], "sh.999999")], "date date, code string")
    got = X.add_history(wanted, history).select(F.coalesce(X.drop_reason(history=True), F.lit("kept")).alias("reason")).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in got} == {"feature_history_missing": 1, "feature_warmup": 60, "kept": 20, "label_5d_outside": 5, "label_20d_outside": 15}


def test_stability_report(spark):
    schema = "factor string, days long, mean_ic double"
    train = spark.createDataFrame([("a", 9, 0.10), ("b", 9, -0.04), ("c", 9, 0.02)], schema)
    later = spark.createDataFrame([("a", 5, 0.03), ("b", 5, 0.05)], schema)
    records = [S.factor_records(x, list("abcd"), n, 5) for x, n in ((train, "train"), (later, "validation"))]
    assert [(r.factor, r.days) for r in records[0].orderBy("position").collect()] == [("a", 9), ("b", 9), ("c", 9), ("d", None)]
    got = {r.factor: r for r in S.stability_report(*records).collect()}
    assert {f: (r.available, r.flipped, r.place) for f, r in got.items()} == {"a": (True, False, 1), "b": (True, True, None), "c": (False, None, None), "d": (False, None, None)}
    assert got["a"].magnitude == 0.03 and got["a"].spearman == pytest.approx(-1.0)
    assert [r.factor for r in S.strongest(records[0], 2).collect()] == ["a", "b"]


def test_normalised_rows_count_as_a_whole(spark):
    good = {
        "date": "2020/1/2", "code": "SH600000", "open": "1", "high": "2", "low": "1", "close": "1.23456", "preclose": "1", "amount": "1,000.555", "turn": "0.1", "pctChg": "-1.5", "volume": "1,000",
        "tradestatus": "1", "isST": "0", "adjustflag": "3", "code_name": " a  b ", "industry_code": "j66", "industry_name": "x", "adjustment": "NONE", "data_source": "s",
    }
    rows = [good, good | {"open": "n/a"}, good | {"volume": "1.5"}, good | {"code_name": None}, good | {"date": "2020-02-30"}]
    got = N.normalize_daily(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in good))).collect()
    assert [r.valid for r in got] == [True, False, False, False, False]
    assert (str(got[0].close), str(got[0].amount), got[0].volume, got[0].code_name, got[0].industry_code, got[0].adjustment) == ("1.2346", "1000.56", 1000, "a b", "J66", "none")
    parts = N.normalize_constituents(spark.createDataFrame([("sz.000001", "n", "j66", "i", "c", "2020-01-02"), ("x", "n", "j66", "i", "c", "2020-01-02")], "code string, code_name string, industry_code string, industry_name string, classification string, updateDate string"))
    assert [r.valid for r in parts.collect()] == [True, False]
    with pytest.raises(ValueError):
        N.at_least(0, 1, "top_k")


def test_snapshots_and_names(spark):
    schema = "code string, code_name string, industry string, updateDate string"
    raw = spark.createDataFrame([("SH.600000", "a", "j66 x", "2020-01-01"), ("sz.000001", "b", "K10", None)], schema)
    take = lambda rows: P.normalize_snapshot(rows, "2020-01-06", "J66", ["industry", "industry_name"], ["industryClassification"], ["updateDate"])
    got = take(raw).collect()
    assert [(r.code, r.industry_code, r.classification, str(r.source_update_date), str(r.effective_date)) for r in got] == [("sh.600000", "J66", "unknown", "2020-01-01", "2020-01-06")]
    for bad in ([("bad", "a", "J66", None)], [("sh.600000", "a", "J66", None), ("SH.600000", "c", "J66", None)]):
        with pytest.raises(ValueError):
            take(spark.createDataFrame(bad, schema))
    names = [spark.createDataFrame(x, "code string, code_name string, at int") for x in ([("a", "old", 1), ("a", "newer", 2), ("b", "first", 1)], [("a", "other", 0), ("b", "", 9)])]
    assert {r.code: r.code_name for r in P.latest_names(*names).collect()} == {"a": "other", "b": "first"}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n", encoding="utf-8")
    assert [tuple(r) for r in T.read_csv(spark, f"{tmp_path}/a.csv", ["x", "y"]).collect()] == [("1", "b")]
    assert T.read_csv(spark, f"{tmp_path}/a.csv", ["y"], exact=False).columns == ["y"]
    with pytest.raises(ValueError):
        T.read_csv(spark, f"{tmp_path}/a.csv", ["y", "x"])
    (tmp_path / "m.json").write_text('{"snapshots": [{"snapshot_date": "2020-01-06"}, "2020-01-13"]}')
    assert [str(r[0]) for r in T.read_snapshot_dates(spark, f"{tmp_path}/m.json").collect()] == ["2020-01-06", "2020-01-13"]
    rows = spark.createDataFrame([(DAY, "train", 1.0 / 3), (days(2)[1], "test", None)], "date date, split string, v double")
    T.write_split(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/split=train").count() == 1
    assert '"v": null' in T.report_json({"rows": rows}) and [r[0] for r in rows.orderBy("date").select(T.number_text(F.col("v"))).collect()] == ["0.333333333333", None]
    T.write_csv(rows.select("split", "v"), f"{tmp_path}/o.csv", ["v", "split"])
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfv,split\n")
    with pytest.raises(ValueError):
        T.write_csv(rows, f"{tmp_path}/p.csv", ["v"])
    bar = {c: "1" for c in T.BAR_NUMBERS} | {"date": "2020-01-02", "code": "a"}
    schema = ", ".join(f"{k} string" for k in bar)
    parts = [spark.createDataFrame([bar | {"code": c, "open": o}], schema) for c, o in (("b", "x"), ("a", "2.5"))]
    names = spark.createDataFrame([("a", "A"), ("a", "A")], "code string, code_name string")
    constants = {"industry_code": "J66", "industry_name": "i", "adjustment": "none", "data_source": "s"}
    got = T.normalize_bars(parts, names, constants).collect()
    assert [(r.code, r.code_name, r.open, r.adjustment) for r in got] == [("a", "A", 2.5, "none"), ("b", None, None, "none")]
    with pytest.raises(ValueError):
        T.normalize_bars(parts, names.unionAll(spark.createDataFrame([("a", "B")], names.schema)), constants)


def test_neighbours_by_blocks(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(120)]
    rows = spark.createDataFrame(vecs, "id long, vec array<double>")
    sent, met = ({(r.query_id, r.place): (r.train_id, r.d2) for r in M.nearest(rows.filter("id < 30"), rows, 7, most=most).collect()} for most in (10**6, 60))
    want = {}
    for q, v in vecs[:30]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), t) for t, w in vecs)[:7]
        want |= {(q, p): (t, d) for p, (d, t) in enumerate(near, 1)}
    assert sent == want and met == want


def test_auc_over_ranges(spark):
    rng = np.random.default_rng(4)
    score, up = rng.integers(0, 50, 900) / 10, rng.integers(0, 2, 900)
    got = S.auc(spark.createDataFrame([(float(a), int(b)) for a, b in zip(score, up, strict=True)], "score double, up int")).first()
    wins = (score[up == 1][:, None] > score[up == 0]).mean() + (score[up == 1][:, None] == score[up == 0]).mean() / 2
    assert got.auc == pytest.approx(wins) and got.ups == up.sum()
    assert S.auc(spark.createDataFrame([(0.5, 1)], "score double, up int")).first().auc is None


def test_logistic_learns_the_sign(spark):
    rows = spark.createDataFrame([(-2.0, 0), (-1.0, 0), (-0.5, 0), (0.5, 1), (1.0, 1), (2.0, 1)], "x double, up int")
    assert M.logistic(rows, ["x"], "up", 1e-3)[1][0] > 0


def test_nearest_neighbours(spark):
    train = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, vec array<double>")
    near = M.nearest(spark.createDataFrame([(100, [0.25, 0.0])], "id long, vec array<double>"), train, 3)
    got = M.neighbour_mean(near, train.select(F.col("id").alias("train_id"), F.col("id").cast("double").alias("y"))).first().prediction
    w = np.array([1 / 0.25, 1 / 0.75, 1 / 1.75])
    assert got == pytest.approx((w @ [0, 1, 2]) / w.sum())


def frame(rows):
    days = {}
    for date, code, *rest in rows:
        days.setdefault(date, {})[code] = SimpleNamespace(**dict(zip(("open", "close", "can_buy", "can_sell"), rest, strict=True)))
    return days


def test_simulation():
    d = days(2)
    free = B.Costs(0, 0, 0, 1, 10_000.0)
    nav, trades = B.simulate_run(frame([(d[0], "a", 10.0, 11.0, True, True), (d[1], "a", 11.0, 12.0, True, True)]), {d[0]: ["a"]}, free, d)
    assert len(trades) == 1 and nav[-1]["nav"] == 12_000
    nav, trades = B.simulate_run(frame([(d[0], "a", 10.0, 11.0, False, True)]), {d[0]: ["a"]}, free, d[:1])
    assert not trades and nav[-1]["nav"] == 10_000


def test_sell_costs():
    d = days(2)
    bars = frame([(d[0], c, 10.0, 10.0, True, True) for c in "ab"] + [(d[1], c, 10.0, 10.0, True, True) for c in "ab"])
    _, trades = B.simulate_run(bars, {d[0]: ["a"], d[1]: ["a", "b"]}, B.Costs(3, 5, 10, 100, 2_100.0), d)
    sell = next(t for t in trades if t["side"] == "sell")
    assert sell["price"] == pytest.approx(9.99) and sell["commission"] == pytest.approx(sell["gross"] * 3e-4) and sell["stamp_tax"] == pytest.approx(sell["gross"] * 5e-4)
    assert sell["slippage"] == pytest.approx(sell["shares"] * 10 * 1e-3)


def test_simulated_grid_by_hand(spark):
    """Three sessions, two codes, two scenarios: buy a, hold over a day without bars, sell a and buy b at the second rebalance."""
    d = days(5)
    bars = [(d[0], "a", 10.0, 11.0), (d[0], "b", 20.0, 20.0), (d[2], "a", 12.0, 12.0), (d[2], "b", 20.0, 22.0), (d[3], "b", 22.0, 25.0), (d[4], "b", 1.0, 1.0)]
    frame = spark.createDataFrame([(*x, "trading", "none") for x in bars], "date date, code string, open double, close double, trading_status string, price_limit_status string")
    cal = spark.createDataFrame([(x, i) for i, x in enumerate(d)], "date date, pos long")
    plans = spark.createDataFrame([("p", 1, d[0], "a", 1), ("p", 1, d[2], "b", 1)], "plan_id string, holding int, execution_date date, code string, place long")
    scenarios = {"free": B.Costs(0, 0, 0, 10, 1_000.0), "paid": B.Costs(100, 200, 100, 10, 1_000.0)}
    events = B.simulate(frame, plans, cal, scenarios)
    nav = {(r.run_id, r.date): (r.nav, r.cash) for r in B.nav_of(events).collect()}
    # free: 100 a at 10; 1,100 at the first close and on the day without bars; 1,200 of cash buys 60 b
    assert {k[1]: v for k, v in nav.items() if k[0] == "free/p"} == {d[0]: (1100.0, 0.0), d[1]: (1100.0, 0.0), d[2]: (1320.0, 0.0), d[3]: (1500.0, 0.0)}
    # paid: a costs 10.1 and 1 %, so 90 of them; sold at 11.88 less 3 %; b costs 20.2 and 1 %
    cash = 1000 - 90 * 10.1 * 1.01
    assert nav["paid/p", d[0]] == (pytest.approx(cash + 90 * 11), pytest.approx(cash))
    cash += 90 * 11.88 * 0.97
    shares = int(cash // (20.2 * 1.01) // 10 * 10)
    cash -= shares * 20.2 * 1.01
    assert nav["paid/p", d[3]] == (pytest.approx(cash + shares * 25), pytest.approx(cash))
    metrics = {r.run_id: r for r in B.portfolio_metrics(B.nav_of(events), B.trades_of(events), 1_000.0).collect()}
    free, paid = metrics["free/p"], metrics["paid/p"]
    assert (free.trade_count, free.rebalance_count, free.total_costs, free.average_exposure, free.final_nav) == (3, 2, 0, 1, 1500)
    assert free.turnover_ratio == pytest.approx((1000 + 1200 + 1200) / ((1100 + 1100 + 1320 + 1500) / 4))
    assert paid.total_stamp_tax == pytest.approx(90 * 11.88 * 0.02) and paid.total_slippage == pytest.approx(90 * 0.1 + 90 * 0.12 + shares * 0.2)
    lost = spark.createDataFrame([("x", d[0], 50.0), ("x", d[1], -5.0)], "run_id string, date date, nav double")
    assert B.value_metrics(lost, 100.0).first().annual_return == -1


def test_equal_weight_takes_all_codes(spark):
    scores = spark.createDataFrame([(DAY, c, 0.0) for c in "bac"], "date date, code string, score double")
    assert [r.code for r in B.top_codes(scores, None).orderBy("place").collect()] == ["a", "b", "c"]


def test_schedule_uses_the_next_session(spark):
    d = days(3)
    scores = spark.createDataFrame([(d[0], "b", 0.3), (d[0], "a", 0.1), (d[0], "c", 0.2), (d[2], "a", 0.1)], "date date, code string, score double")
    cal = spark.createDataFrame([(x, i) for i, x in enumerate(d)], "date date, pos long")
    got = [(r.execution_date, r.code) for r in B.schedule(scores, cal, 2, 1).orderBy("place").collect()]
    assert got == [(d[1], "b"), (d[1], "c")]


def test_neighbours_among_all_rows(spark, tmp_path):
    from tidemark.plans.catalogue import QUERIES

    vecs = [(i, [float(i * 37 % 101), float(i * 11 % 13)], i % 3) for i in range(250)] + [(300, [1.0, 1.0], 1), (7000, [1.0, 1.0], 2)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.place): r.train_id for r in QUERIES["q40_knn"](spark, str(tmp_path)).collect()}
    want = {}
    for q, x, _ in vecs:
        if q % 100 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), t) for t, y, _ in vecs if t != q)
            want |= {(q, p): t for p, (_, t) in enumerate(near[:5], 1)}
    assert got == want and {t % 10 == 0 for t in got.values()} == {True, False}
