import datetime as dt

import pytest

from roaskit.operators import ingest as I
from roaskit.functions.scalars import to_money, to_number
from roaskit.plans.ingesting import ingest_folder
from roaskit.sources import exports as X


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def rows_of(df, *cols):
    return [tuple(r) for r in df.orderBy("_pos").select(*cols).collect()]


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "Google_Ads.csv", "Campaign ID,date,Clicks,Conversions,Cost Micros,Impr,Revenue,Campaign-Type,Name\n"
          "1,2024-01-01,10,1,2500000,100,40,PerformanceMax,A\n"
          "2,bad,5,1,-1000000,0,x,Demand - Gen,\n"
          "3,2024-01-03,5,1,1500000000,0,-7,,B\n"
          "4,worse,5,1,1,1,1,search,C\n")
    write(tmp_path, "meta.csv", "id,date_start,spend,conversion,clicks,impressions,campaign_name\n"
          "9,2024-01-02,10,100,3,50,M\n")
    write(tmp_path, "ms_ads_export.csv", "CampaignId,TimePeriod,Spend,Revenue,Impressions,Conversions,CampaignType,CampaignName\n"
          "7,2024-01-01,3,30,20,2,PerformanceMax,K\n7,2024-01-01,4,50,20,2,PerformanceMax,K\n")
    write(tmp_path, "tiktok.csv", "a,b\n1,2\n")
    write(tmp_path, "notes.txt", "none")
    return tmp_path


def test_discovery_and_file_audit(spark, folder):
    files = X.list_files(spark, str(folder))
    found = {r.platform: r.path.rsplit("/", 1)[-1] for r in X.discover_exports(files).collect()}
    assert found == {"google": "Google_Ads.csv", "meta": "meta.csv", "bing": "ms_ads_export.csv"}
    assert [r.name for r in X.unrecognized_exports(files).collect()] == ["tiktok.csv"]
    audit = {r.check: (r.penalty, r.affected) for r in X.file_audit(spark, files).collect()}
    assert audit == {"file_unrecognized": (10.0, 1)}


def test_missing_platforms_cost_twenty_each(spark, tmp_path):
    write(tmp_path, "google.csv", "a\n1\n")
    files = X.list_files(spark, str(tmp_path))
    ledger = X.file_audit(spark, files)
    assert sorted((r.platform, r.penalty) for r in ledger.collect()) == [("bing", 20.0), ("meta", 20.0)]
    assert I.quality_score(ledger).first().quality_score == 60.0


def test_google_rows(spark, folder):
    raw = X.read_export(spark, str(folder / "Google_Ads.csv"))
    got = rows_of(I.clip_negative(I.read_google(raw)), "date", "campaign_name", "campaign_type", "spend", "revenue")
    d = dt.date
    assert [(r[0], r[1], r[2], float(r[3]), float(r[4])) for r in got] == [
        (d(2024, 1, 1), "A", "PERFORMANCE_MAX", 2.5, 40.0),
        (d(2024, 1, 3), "Google_Generic_Campaign", "DEMAND_GEN", 0.0, 0.0),
        (d(2024, 1, 3), "B", "SEARCH", 1500.0, 0.0),
        (d(2025, 1, 1), "C", "SEARCH", 1e-6, 1.0)]


def test_google_ledger_and_suspicious(spark, folder):
    raw = X.read_export(spark, str(folder / "Google_Ads.csv"))
    ledger = {r.check: (r.affected, r.penalty) for r in I.audit(raw, I.google_rows(raw), I.GOOGLE).collect()}
    assert ledger == {"rows_read": (4, 0.0), "bad_dates": (2, 2.0), "negative_spend": (1, 3.0),
                      "negative_revenue": (1, 3.0), "suspicious": (1, 4.0)}
    assert I.suspicious_rows(I.read_google(raw)).count() == 1


def test_a_missing_column_is_charged_twice(spark, folder):
    raw = X.read_export(spark, str(folder / "ms_ads_export.csv"))
    ledger = I.audit(raw, I.bing_rows(raw), I.BING)
    assert I.quality_score(ledger).first().quality_score == 90.0
    assert I.quality_score(ledger).first().critical_warnings == 2
    assert {r.clicks for r in I.read_bing(raw).collect()} == {0.0}


def test_direct_dollars_and_last_of_equal_headers(spark, tmp_path):
    path = write(tmp_path, "g.csv", "id,date,spend,revenue,campaign name,campaign_name\n1,2024-01-01,12.5,3,first,last\n")
    raw = X.read_export(spark, path)
    row = I.read_google(raw).first()
    assert float(row.spend) == 12.5 and row.campaign_name == "last"


def test_meta_revenue_source_and_counts(spark, tmp_path):
    both = X.read_export(spark, write(tmp_path, "m1.csv",
        "id,date,cost,conversion,revenue,conversions\n1,2024-01-01,5,9,70,4\n"))
    row = I.read_meta(both).first()
    assert (float(row.revenue), row.conversions) == (70.0, 4.0)
    plain = X.read_export(spark, write(tmp_path, "m2.csv", "id,date,cost,conversion\n1,2024-01-01,5,100\n"))
    row = I.read_meta(plain).first()
    assert (float(row.revenue), row.conversions) == (100.0, 2.0)


def test_ingest_end_to_end(spark, folder):
    raws = {p: X.read_export(spark, str(folder / n)) for p, n in (
        ("google", "Google_Ads.csv"), ("bing", "ms_ads_export.csv"), ("meta", "meta.csv"))}
    facts, ledger = I.ingest(**raws)
    merged = I.merge_duplicates(facts)
    assert facts.count() == 7 and merged.count() == 6
    assert I.duplicate_count(merged).first().duplicates == 1
    # Meta: 100 revenue at (40 + 0 + 0 + 1 + 80) / 8 a conversion.
    meta = merged.filter("channel = 'Meta Ads'").first()
    assert meta.conversions == pytest.approx(100 / (121 / 8))
    summary = I.validation_summary(merged).first()
    assert summary.channel_record_counts == {"Google Ads": 4, "Bing Ads": 1, "Meta Ads": 1}
    score = I.quality_score(ledger).first().quality_score
    assert score == 100 - 12 - 10 - 3
    with pytest.raises(ValueError):
        I.ingest()


def test_corrupt_lines_are_noted(spark, tmp_path):
    raw = X.read_export(spark, write(tmp_path, "g.csv", "id,date,spend\n1,2024-01-01,5\n2,2024-01-02,6,7,8\n"))
    assert [(r.check, r.affected) for r in I.corrupt_lines(raw, "google").collect()] == [("corrupt_lines", 1)]


def test_back_fill_over_many_blocks(spark, tmp_path):
    lines, want, nxt = [], [], None
    n = 4000
    days = [None if (i % 97 or i > 3900) else dt.date(2020, 1, 1) + dt.timedelta(days=i // 97) for i in range(n)]
    for i in range(n):
        lines.append(f"{i},{days[i] or 'bad'},1,1,1,1,1,x,name{i}")
    for d in reversed(days):
        nxt = d or nxt
        want.append(nxt or dt.date(2025, 1, 1))
    path = write(tmp_path, "google.csv", "campaign_id,date,clicks,conversions,cost_micros,impressions,value,"
                 "channel_type,campaign_name\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        raw = X.read_export(spark, path)
        got = I.read_google(raw)
        assert got.select("_block").distinct().count() > 5
        by_id = {int(r.campaign_id): r.date for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [by_id[i] for i in range(n)] == want[::-1]


def test_dates_as_exports_write_them(spark):
    days = {"2024-01-02": 2, "1/2/2024": 2, "01/02/2024": 2, "20240102": 2, "Jan 2, 2024": 2, "January 2, 2024": 2, "2024/01/02": 2, "2 Jan 2024": 2,
            "2024-01-02T23:30:00+09:00": 2, "2024-01-02 00:30:00 -0500": 2, " 2024-01-03 ": 3, "unknown": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in days], "t string").select("t", I.parsed_day("t").alias("d")).collect()
    assert {r.t: r.d for r in rows} == {t: d and dt.date(2024, 1, d) for t, d in days.items()}


def test_numbers_that_are_none(spark):
    texts = {"2000000000000": 2e12, "NaN": 0.0, "Infinity": 0.0, "-inf": 0.0, "1e3": 1000.0, "x": 0.0, None: 0.0}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_number("t").alias("n"), to_money("t").alias("m")).collect()
    assert {r.t: r.n for r in rows} == texts and {r.t: float(r.m) for r in rows} == texts


def test_a_folder_in_one_go(spark, tmp_path):
    """Two google files of different headers, a bing file without a header, no meta file, one file of nobody."""
    write(tmp_path, "google_1.csv", "campaign_id,date,clicks,conversions,spend,impressions,value,channel_type,campaign_name\n"
          "1,1/5/2024,NA,1,10,100,40,SEARCH,a\n1,2024-01-05,3,1,5,100,20,SEARCH,a\n2,oops,NaN,n/a,7,50,,SEARCH,b\n")
    write(tmp_path, "google_2.csv", "date,campaign_id,spend,value,clicks,conversions,impressions,channel_type,campaign_name\n"
          "2024-01-06,3,8,16,1,1,10,SEARCH,c\n2024-01-07,3,8,16,1,1,10,SEARCH,c,too,long\n")
    write(tmp_path, "bing.csv", "1,2,3\n4,5,6\n")
    write(tmp_path, "tiktok.csv", "id\n1\n")
    got = ingest_folder(spark, str(tmp_path))
    assert [(str(r.date), r.campaign_id, float(r.spend), r.source_rows) for r in got.facts.collect()] == [
        ("2024-01-05", "1", 15.0, 2), ("2024-01-06", "3", 8.0, 1), ("2024-01-07", "3", 8.0, 1), ("2025-01-01", "2", 7.0, 1)]
    charged = {(r.platform, r.check): r.penalty for r in got.ledger.collect() if r.penalty}
    assert charged == {("meta", "file_missing"): 20.0, ("folder", "file_unrecognized"): 10.0, ("bing", "unreadable"): 15.0,
                       ("google", "bad_dates"): 2.0, ("all", "duplicates"): 3.0}
    assert got.score.first().quality_score == 50.0
    assert got.ledger.filter("check = 'corrupt_lines'").first().affected == 1
    first = ingest_folder(spark, str(tmp_path), first_only=True)
    assert first.facts.count() == 2 and first.ledger.filter("check = 'file_left_out'").first().affected == 1


def test_fill_crosses_blocks_and_superblocks_and_moves_bad_rows_only(spark):
    import random

    from roaskit.sources.storage import materialize
    rng, rows, want = random.Random(4), [], []
    for file, blocks in (("a", [0, 1, 2, 5, 1023, 1024, 1030, 3000, 5000]), ("b", [7]), ("c", [1, 2])):
        days = []
        for b in blocks:
            for p in range(4):
                value = None if rng.random() < 0.6 or b in (1024, 1030, 3000) or file == "c" else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(300))
                days.append((file, b, p, value, f"{file}-{b}-{p}"))
        after = None
        for r in reversed(days):
            after = r[3] or after
            want.append((r[4], after))
        rows += days
    rng.shuffle(rows)
    df = materialize(spark.createDataFrame(rows, "_file string, _block long, _pos long, d date, payload string"), "rows")
    got = I.next_valid(df, "d", "filled")
    assert sorted((r.payload, str(r.filled)) for r in got.collect()) == sorted((p, str(v)) for p, v in want)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    nodes = got._jdf.queryExecution().explainString(mode).split("\n\n")
    moved = [n for n in nodes if ") Exchange" in n]
    assert moved and not any("payload" in n for n in moved)  # whole rows move only as a bad row's struct


def test_parts_of_a_platform_are_charged_once(spark, tmp_path):
    def part(name, header, rows):
        f = tmp_path / name
        f.write_text("\n".join([header, *rows]) + "\n")
        return X.read_export(spark, [str(f)])
    one = part("g1.csv", "campaign_id,segments_date,clicks,conversions,cost_micros,campaign_name", ["1,oops,1,1,1000000,a", "2,2024-01-02,1,1,1000000,b"])
    two = part("g2.csv", "campaign_id,segments_date,clicks,conversions,cost_micros,campaign_name,impressions", ["3,never,1,1,1000000,a,5"])
    facts, ledger = I.ingest(google=[one, two])
    got = {r.check: (r.affected, r.penalty) for r in ledger.collect()}
    whole = {r.check: (r.affected, r.penalty) for r in I.ingest(google=one)[1].collect()}
    assert got["bad_dates"] == (2, 2.0) and got["rows_read"][0] == 3
    assert {k for k in got if k.startswith("column")} == {k for k in whole if k.startswith("column")}
    assert facts.count() == 3


def raw_texts(spark):
    """Rows as three platforms write them, with bad dates, negative and missing amounts and a key that repeats."""
    def rows(*cols):
        days = ["2024-01-05", "unknown", "1/6/2024", "2024-01-05", "2024-01-09"]
        data = [("f", 0, i, "1" if i != 2 else None, d, ["5", "-2", "x", "2000", None][i], "40", "0", "3") for i, d in enumerate(days)]
        return spark.createDataFrame(data, ["_file", "_block", "_pos", *cols])
    return {"google": rows("campaign_id", "date", "spend", "revenue", "impressions", "clicks"),
            "bing": rows("CampaignId", "TimePeriod", "Spend", "Revenue", "Impressions", "Conversions"),
            "meta": [rows("id", "date_start", "spend", "conversion", "impressions", "clicks")]}


def test_typed_rows_are_compiled(spark):
    """The JVM leaves methods of over 8,000 bytes to its interpreter: there the dates took most of the ingest's time."""
    import contextlib
    import io
    import re
    given = raw_texts(spark)
    for made in (I.google_rows(given["google"]), I.bing_rows(given["bing"]), I.meta_rows(given["meta"][0])):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            made.withColumn("_parsed", I.parsed_day("_day")).explain("codegen")
        assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue()))


def test_ledger_alone_is_that_of_the_ingest_and_writes_what_it_reads(spark, monkeypatch):
    given = raw_texts(spark)
    whole = sorted(map(tuple, I.ingest(**given)[1].collect()))
    written, materialize = {}, I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, label: (written.setdefault(label, df.columns), materialize(df, label))[1])
    assert sorted(map(tuple, I.ingest_ledger(**given).collect())) == whole
    assert {r[1] for r in whole} >= {"bad_dates", "negative_money", "negative_spend", "duplicates", "suspicious"}
    assert set(written["typed"]) == {*I.AUDITED, "_parsed"}
    with pytest.raises(ValueError):
        I.ingest_ledger()
