import datetime as dt

import pytest
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.operators import anchor as A
from roaskit.operators import boosting as BO
from roaskit.operators import effects as EF
from roaskit.operators import ensemble as EN
from roaskit.operators import features as FE
from roaskit.operators import forecast as FC
from roaskit.operators import leastsquares as LS
from roaskit.plans import forecasting, scoring
from roaskit.sources import state
from roaskit.sources.tables import event_ad_rows
from roaskit.streaming import ingest as ST
from tests.conftest import SF


@pytest.fixture
def series(make_series):
    start = dt.date(2024, 1, 1)
    return make_series([(start + dt.timedelta(days=i), 100 + i % 7, 20) for i in range(100)], "Overall", "Total Portfolio")


def tables(spark, series):
    seasonal = LS.fit_seasonal(series)
    return {"entity_model": EF.fit_effects(series), "entity_baseline": A.recent_anchors(series), "portfolio_seasonal": seasonal,
            "portfolio_spread": seasonal.select("dimension_type", "dimension_value", "revenue_std", "spend_std"),
            "campaign_map": spark.createDataFrame([], "campaign_name string, channel string, channel_share double"),
            "fallback_scale": spark.createDataFrame([], "dimension_type string, scale double"),
            "params": state.params_table(spark)}


def test_state_survives_a_round_trip(spark, series, tmp_path):
    state.save_state(tables(spark, series), str(tmp_path / "s"))
    got = state.load_state(spark, str(tmp_path / "s"))
    start = F.lit(dt.date(2024, 4, 10))
    fresh = FC.daily_forecast(EF.fit_effects(series), A.recent_anchors(series), start)
    again = FC.daily_forecast(got["entity_model"], got["entity_baseline"], start)
    assert fresh.orderBy("day").collect() == again.orderBy("day").collect()


def test_absent_or_damaged_state_raises(spark, series, tmp_path):
    with pytest.raises(state.StateError):
        state.load_state(spark, str(tmp_path / "none"))
    bad = tmp_path / "bad"
    state.save_state(tables(spark, series), str(bad))
    for f in bad.glob("version-*/entity_model/*.parquet"):
        f.write_bytes(b"not a table")
    with pytest.raises(state.StateError):
        state.load_state(spark, str(bad))
    gone = tmp_path / "gone"
    state.save_state(tables(spark, series), str(gone))
    part = sorted(gone.glob("version-*/entity_baseline/part-*.parquet"), key=lambda f: f.stat().st_size)[-1]
    spark.createDataFrame([], A.recent_anchors(series).schema).coalesce(1).write.mode("append").parquet(str(part.parent))
    other = A.recent_anchors(series)
    other.write.mode("append").parquet(str(part.parent))
    with pytest.raises(state.StateError, match="damaged"):
        state.load_state(spark, str(gone))
    (bad / "manifest.json").write_text("{")
    with pytest.raises(state.StateError, match="manifest"):
        state.load_state(spark, str(bad))
    short = tmp_path / "short"
    state.save_state({**tables(spark, series), "params": spark.createDataFrame([("a",)], "name string")}, str(short))
    with pytest.raises(state.StateError, match="lacks"):
        state.load_state(spark, str(short))
    with pytest.raises(state.StateError):
        state.save_state({}, str(tmp_path / "x"))


def test_a_new_version_replaces_the_state_at_once(spark, series, tmp_path):
    path = str(tmp_path / "s")
    first = state.save_state(tables(spark, series), path)
    held = state.load_state(spark, path)["entity_baseline"]
    second = state.save_state({**tables(spark, series), "params": state.params_table(spark, top_down_weight=0.25)}, path)
    assert held.count() == 1                                # a reader of the version before goes on
    assert state.params_of(state.load_state(spark, path)["params"])["top_down_weight"] == 0.25
    # a write that ends half way changes nothing
    with pytest.raises(Exception):  # noqa: B017, PT011 - whatever the task raises
        state.write_version(spark, {"params": spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))}, path)
    assert state.read_manifest(spark, path)["version"] == second
    state.save_state(tables(spark, series), path)
    left = {p.name for p in (tmp_path / "s").glob("version-*/params")} | {p.parent.name for p in (tmp_path / "s").glob("version-*/params")}
    assert first not in left and second in left
    assert state.params_of(spark.createDataFrame([], "name string, value double")) == state.PARAM_DEFAULTS


def facts_of(rows, spark):
    return spark.createDataFrame(rows, "date date, channel string, campaign_type string, campaign_name string, revenue double, spend double, "
                                 "clicks double, impressions double, conversions double")


def test_prediction_from_state_fits_nothing(spark, tmp_path, monkeypatch):
    rows = []
    for i in range(420):
        d = dt.date(2023, 1, 1) + dt.timedelta(days=i)
        for ch, level in (("G", 500.0), ("M", 200.0)):
            rows.append((d, ch, "t" + ch, "c" + ch, level * (4 + i % 7 / 10), level, 10.0, 100.0, 1.0))
        if i >= 400:
            rows.append((d, "New", "tNew", "cNew", 50.0, 10.0, 10.0, 100.0, 1.0))
    facts = facts_of(rows, spark).cache()
    old = facts.filter("date < date '2023-12-01'")
    want = {}
    for name, members in (("linear", P.LINEAR_MEMBERS), ("trees", tuple(P.ENSEMBLE_WEIGHTS))):
        state.save_state(scoring.fit_state(old, members), str(tmp_path / name))
        want[name] = forecasting.predictions(old, members).collect()

    def never(*_, **__):
        raise AssertionError("fitted")
    for module, f in ((EF, "fit_effects"), (LS, "fit_seasonal"), (BO, "fit_trees"), (EN, "fit_portfolio"), (scoring, "fit_portfolio")):
        monkeypatch.setattr(module, f, never)
    for name in want:
        # over the facts it was fitted on it gives what a fit gives
        got = scoring.predict_from_state(spark, old, str(tmp_path / name)).collect()
        key = lambda r: (r.dimension_type, r.dimension_value, r.forecast_period, r.metric)
        assert {key(r): pytest.approx((r.p10, r.p50, r.p90), abs=0.02) for r in want[name]} == {key(r): (r.p10, r.p50, r.p90) for r in got}
        # newer facts move the anchors, and what the state does not know falls back on the portfolio
        now = {key(r): r for r in scoring.predict_from_state(spark, facts, str(tmp_path / name)).collect()}
        overall, new = now["Overall", "Total Portfolio", "30_days", "Revenue"], now["Channel", "New", "30_days", "Revenue"]
        assert new.p50 == pytest.approx(0.5 * overall.p50, rel=1e-3)   # the median share of the two channels it knows
        assert now["Channel", "G", "30_days", "Revenue"].p50 > 0
    with pytest.raises(state.StateError):
        scoring.predict_from_state(spark, facts, str(tmp_path / "nowhere"))


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(4):
        one = spark.createDataFrame([(f"run{i}", '{"q": "%d"}' % i, '{"risk": "Low"}', dt.datetime(2024, 1, 1 + i))], state.RUN_SCHEMA)
        state.append_run(one, path)
    got = state.recent_runs(spark.read.parquet(path), 2).collect()
    assert [r.run_label for r in got] == ["run3", "run2"]
    assert got[0].parameters == {"q": "3"} and got[0].created_at == "2024-01-04 00:00:00"
    row = state.run_row(spark.createDataFrame([(95.0, 3)], "quality double, n int"), "auto", ["quality"], ["n"]).first()
    assert row.parameters_json == '{"quality":95.0}' and row.summary_json == '{"n":3}'


def test_written_results_read_back(spark, tmp_path):
    score = spark.createDataFrame([(dt.date(2024, 1, 1), "Overall", "T", "30_days", "Revenue", 1.0, 0.5, 1.0, 2.0, 0.0, 0.0, 0.0, True)],
                                  state.SCORECARD_SCHEMA)
    state.write_backtest(score, score, spark.createDataFrame([(1,)], "folds int"), str(tmp_path / "bt"))
    card, summary = state.read_backtest(spark, str(tmp_path / "bt"))
    assert card.collect() == score.collect() and summary.first().folds == 1
    with pytest.raises(state.StateError):
        state.read_backtest(spark, str(tmp_path / "none"))
    facts = spark.createDataFrame([(dt.date(2024, 1, 1), 2.0)], "date date, x double")
    for fmt in ("parquet", "csv"):
        FE.write_features(facts, str(tmp_path / fmt), fmt)
        assert state.read_features(spark, str(tmp_path / fmt), fmt).select("date", "x").collect() == facts.collect()
    with pytest.raises(state.StateError):
        state.read_features(spark, str(tmp_path / "none"))
    state.log_datasets(facts.withColumn("channel", F.lit("G")), spark.createDataFrame([(90.0,)], "quality_score double"),
                       "g.csv", str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first().record_count == 1


@pytest.fixture
def event_files(spark, tmp_path):
    """The events in three files, in order of time."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    for i, (lo, hi) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01"))):
        part = ev.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), ev


def day_rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(
        "date", "channel", *[F.col(m).cast("decimal(20,4)") for m in ST.MEASURES]).collect())


def test_stream_equals_table(spark, event_files):
    folder, ev = event_files
    batch = event_ad_rows(ev).groupBy(F.to_date("ts").alias("date"), "channel").agg(*[F.sum(m).alias(m) for m in ST.MEASURES])
    stream = ST.stream_daily(ST.stream_events(spark, folder, "*.parquet", files_per_batch=3))
    assert day_rows(stream) == day_rows(batch)


def test_rows_behind_the_watermark_drop(spark, tmp_path):
    def write(rows, n):
        spark.createDataFrame(rows, ST.EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/f{n}"))
    t = dt.datetime
    write([(1, t(2024, 1, 10), 0, "purchase", 5.0, "{}")], 1)
    write([(2, t(2024, 1, 11), 0, "purchase", 1.0, "{}")], 2)
    write([(3, t(2024, 1, 2), 0, "purchase", 7.0, "{}")], 3)
    events = (spark.readStream.schema(ST.EVENT_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    got = {str(r.date): float(r.revenue) for r in ST.stream_daily(events).collect()}
    assert got == {"2024-01-10": 5.0, "2024-01-11": 1.0}


def test_stream_refresh_equals_batch_anchors(spark, event_files):
    folder, ev = event_files
    daily = event_ad_rows(ev).groupBy(F.to_date("ts").alias("date"), "channel").agg(*[F.sum(m).alias(m) for m in ST.MEASURES])
    want = {r.dimension_value: r for r in A.recent_anchors(ST.channel_series(daily)).collect()}
    got = ST.stream_refresh(ST.stream_events(spark, folder, "*.parquet", files_per_batch=3)).collect()
    assert {r.dimension_value for r in got} == set(want)
    for r in got:
        assert r.daily_revenue == pytest.approx(want[r.dimension_value].daily_revenue)


def test_a_second_call_reads_new_files_only_and_goes_on(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    cuts = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]

    def put(i):
        part = ev.filter((F.col("ts") >= cuts[i]) & (F.col("ts") < cuts[i + 1]))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return part.count()

    def calls():
        return ST.stream_events(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=1)
    put(1)
    spark.createDataFrame([], ST.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    progress, folder = str(tmp_path / "p"), f"{tmp_path}/p/state"
    ST.stream_refresh(calls(), progress=progress)
    late, new = put(0), put(2)                              # days before those seen, and after
    refresher = ST.AnchorRefresher(spark, folder)
    assert ST.run_available(ST.stream_facts(calls()), refresher, "append", "refresh", progress) == late + new
    assert ST.run_available(ST.stream_facts(calls()), refresher, "append", "refresh", progress) == 0
    daily = event_ad_rows(ev).groupBy(F.to_date("ts").alias("date"), "channel").agg(*[F.sum(m).alias(m) for m in ST.MEASURES])
    cols = ["dimension_value", "last_date", "rows_used", "daily_revenue", "daily_spend", "revenue_trend_per_day"]

    def table(df):
        return {r[0]: tuple(pytest.approx(x) if isinstance(x, float) else x for x in r[1:]) for r in df.select(*cols).collect()}
    plain = {r[0]: tuple(r[1:]) for r in A.recent_anchors(ST.channel_series(daily)).select(*cols).collect()}
    assert table(refresher.anchors()) == plain
    # a batch that is done again leaves what it gave before
    last = state.read_manifest(spark, folder)["extra"]["batch"]
    manifest = state.read_manifest(spark, folder)
    before = state.read_version(spark, folder, manifest)["months"].collect()
    refresher(ST.stream_facts(ev.limit(0)), last + 1)
    refresher(ST.stream_facts(ev), last + 2)
    refresher(ST.stream_facts(ev.limit(0)), last + 2)       # the batch again, as it really is
    after = state.read_version(spark, folder, state.read_manifest(spark, folder))["months"].collect()
    assert sorted(map(str, after)) == sorted(map(str, before))
    assert len(list((tmp_path / "p/state").glob("version-*"))) <= 3


def test_kept_days_and_months_equal_the_whole_history(spark, tmp_path):
    refresher, rows = ST.AnchorRefresher(spark, str(tmp_path / "s")), []
    start = dt.datetime(2021, 1, 1)
    for b in range(6):
        part = []
        for i in range(150):
            day = b * 140 + i - (30 if i % 9 == 0 else 0)   # each batch has days of those before
            if day % 13:
                peak = 6.0 if (start + dt.timedelta(days=day)).month == 12 else 1.0
                part.append((start + dt.timedelta(days=day), "A" if day % 5 else "B", 10.0 * peak + day % 7, 3.0))
        df = spark.createDataFrame(part, "ts timestamp, channel string, revenue double, spend double")
        rows += part
        refresher(df, b)
    whole = spark.createDataFrame(rows, "ts timestamp, channel string, revenue double, spend double")
    series = whole.groupBy(F.to_date("ts").alias("date"), "channel").agg(F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))
    cols = ["dimension_value", "last_date", "rows_used", "daily_revenue", "daily_spend", "revenue_trend_per_day", "revenue_deseasonalized"]
    want = {r[0]: r for r in A.recent_anchors(ST.channel_series(series)).select(*cols).collect()}
    got = {r[0]: r for r in refresher.anchors().select(*cols).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r[1:3] == want[k][1:3] and r[6] == want[k][6] and tuple(r[3:6]) == pytest.approx(tuple(want[k][3:6]))
