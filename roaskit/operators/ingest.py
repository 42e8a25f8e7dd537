"""From messy channel exports to clean campaign rows, with a ledger of what was wrong."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach, scalar_of
from roaskit.functions.scalars import MONEY, canonical_type, clamp, to_money, to_number
from roaskit.operators.quantiles import count_over_percentile, exact_percentile
from roaskit.sources.exports import CORRUPT
from roaskit.sources.storage import materialize

FACT_COLUMNS = ("date", "channel", "campaign_id", "campaign_name", "campaign_type",
                "spend", "revenue", "clicks", "impressions", "conversions")
ORDER_COLUMNS = ("_file", "_block", "_pos")
#: To be raised when an audit would find or charge something else: stored ledgers of other rules are not read.
AUDIT_RULES = 1
LEDGER_SCHEMA = "platform string, check string, affected long, penalty double, message string"


@dataclass(frozen=True)
class ExportSpec:
    """What one platform calls its columns, and what stands in for absent ones."""

    platform: str
    channel: str
    columns: dict[str, tuple[str, ...]]
    date: str
    text_default: str
    text_columns: tuple[str, ...]
    generic_name: str = field(default="")


# Standard column -> accepted spellings, in the order they are tried.
GOOGLE = ExportSpec(
    "google", "Google Ads",
    {
        "campaign_id": ("id", "campaignid"),
        "segments_date": ("date", "segment_date"),
        "metrics_clicks": ("clicks", "click"),
        "metrics_conversions": ("conversions", "conversion"),
        "metrics_cost_micros": ("cost_micros", "cost", "spend_micros", "spend"),
        "metrics_impressions": ("impressions", "impr"),
        "metrics_conversions_value": ("conversions_value", "value", "revenue"),
        "campaign_advertising_channel_type":
            ("advertising_channel_type", "channel_type", "campaign_type"),
        "campaign_name": ("name", "campaign"),
    },
    "segments_date", "UNKNOWN_SEARCH",
    ("campaign_advertising_channel_type", "campaign_name"), "Google_Generic_Campaign")

META = ExportSpec(
    "meta", "Meta Ads",
    {
        "campaign_id": ("id", "campaignid"),
        "date_start": ("date", "start_date"),
        "spend": ("cost",),
        "conversion": ("revenue", "conversion_value", "conversions_value", "purchase_value",
                       "value"),
        "clicks": ("click",),
        "impressions": ("impr",),
        "campaign_name": ("name", "campaign"),
    },
    "date_start", "Meta_Generic_Campaign", ("campaign_name",), "Meta_Generic_Campaign")

BING = ExportSpec(
    "bing", "Bing Ads",
    {
        "CampaignId": ("campaign_id", "id"),
        "TimePeriod": ("date", "time_period", "period"),
        "Spend": ("cost",),
        "Revenue": ("value",),
        "Clicks": ("click",),
        "Impressions": ("impr",),
        "Conversions": ("conversion",),
        "CampaignType": ("campaign_type", "type"),
        "CampaignName": ("campaign_name", "name"),
    },
    "TimePeriod", "Bing_Search_Generic", ("CampaignType", "CampaignName"),
    "Bing_Generic_Campaign")

# Where Meta's revenue and conversion count come from, first present wins.
META_REVENUE = ("revenue", "conversion_value", "conversions_value", "purchase_value", "value",
                "conversion")
META_COUNT = ("conversions", "conversion_count", "purchases", "purchase_count")
# A google header with one of these has its cost in micros.
GOOGLE_MICROS = ("metrics_cost_micros", "cost_micros", "spend_micros")


def header_key(name: str) -> str:
    """The spelling headers are compared by."""
    words = name.lower().replace(" ", "_").replace("-", "_").split("_")
    return "_".join(w for w in words if w)


def header_index(df: DataFrame) -> dict[str, str]:
    """Compared spelling -> actual column; of two that compare equal the last counts."""
    return {header_key(c): c for c in df.columns if c not in (*ORDER_COLUMNS, CORRUPT)}


def resolve_aliases(df: DataFrame, spec: ExportSpec) -> dict[str, str | None]:
    """Standard column -> actual column of `df`, or None. Looks at names only."""
    index = header_index(df)
    found = {}
    for standard, aliases in spec.columns.items():
        tries = [header_key(n) for n in (standard, *aliases)]
        found[standard] = next((index[t] for t in tries if t in index), None)
    return found


def imputed(spec: ExportSpec, standard: str) -> Column:
    """The stand-in for a column the export does not have."""
    if standard == spec.date:
        return F.lit(P.DEFAULT_DATE)
    if standard in spec.text_columns:
        return F.lit(spec.text_default)
    return F.lit("0")


def standard_columns(df: DataFrame, spec: ExportSpec, extra: dict[str, Column] | None = None
                     ) -> DataFrame:
    """Row order and the standard columns, absent ones imputed; one projection."""
    found = resolve_aliases(df, spec)
    keep = [c for c in (*ORDER_COLUMNS, CORRUPT) if c in df.columns]
    cols = [(F.col(f"`{actual}`").cast("string") if actual else imputed(spec, s)).alias(f"s_{s}")
            for s, actual in found.items()]
    return df.select(*keep, *cols, *[c.alias(n) for n, c in (extra or {}).items()])


#: Blocks whose summaries are carried on together.
SUPERBLOCK = 1024


def first_valid_behind(blocks: DataFrame, value: str, out: str) -> DataFrame:
    """_file, _block, out: the first non-null `value` of the blocks behind each block of a file.

    blocks: one row a block. A window holds the blocks of one superblock, and one more the
    superblocks of a file; from the back to the front its frame only grows.
    """
    placed = blocks.withColumn("_super", F.floor(F.col("_block") / SUPERBLOCK))
    tops = placed.groupBy("_file", "_super").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_block"))).alias("_top"))

    def ahead(*keys: str, order: str):
        return Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)

    tops = tops.select("_file", "_super", F.last("_top", ignorenulls=True).over(ahead("_file", order="_super")).alias("_next_top"))
    near = F.last(value, ignorenulls=True).over(ahead("_file", "_super", order="_block"))
    return (placed.withColumn("_near", near).join(tops, ["_file", "_super"])
            .select("_file", "_block", F.coalesce("_near", "_next_top").alias(out)))


def next_valid(rows: DataFrame, value: str, out: str) -> DataFrame:
    """`out` = `value`, or where it is null the next non-null one in row order.

    The order is `_block`, `_pos` within `_file`; `rows` is a written table. Rows that have a
    value stay where they are. Only blocks with a null are put in order, and of their other
    rows only place and value move; what a block can't fill takes the first value of the
    blocks behind it.
    """
    have = F.col(value).isNotNull()
    good = rows.filter(have).withColumn(out, F.col(value))
    dirty = rows.filter(~have).select("_file", "_block").distinct()
    blocks = rows.groupBy("_file", "_block").agg(F.min_by(value, F.when(have, F.col("_pos"))).alias("_first"))
    carried = first_valid_behind(blocks, "_first", "_carry").join(dirty, ["_file", "_block"], "left_semi")
    slim = rows.select("_file", "_block", "_pos", F.col(value).alias("_value"), F.when(~have, F.struct(*rows.columns)).alias("_row"))
    inside = (Window.partitionBy("_file", "_block").orderBy(F.col("_pos").desc(), F.col("_value").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bad = (slim.join(carried, ["_file", "_block"])
           .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_carry"))
           .filter(F.col("_row").isNotNull()).select("_row.*", out))
    return good.unionByName(bad)


#: Spellings of a date beside ISO ones, tried in this order; of two numbers the month comes first.
DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyyMMdd", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")


def odd_day(text: Column) -> Column:
    """The day of a text that isn't a plain ISO date, by the first spelling that fits."""
    day = F.regexp_replace(F.trim(text), r"[T ]\d{1,2}:\d{2}.*$", "")
    return F.coalesce(F.to_date(day.try_cast("timestamp")), *[F.to_date(F.try_to_timestamp(day, F.lit(f))) for f in DATE_FORMATS])


def parsed_day(text: str) -> Column:
    """The day a text names. A time of day is left out, and so is its offset: the day is the one written.

    The many spellings are tried inside a lambda: written out in the projection they made its
    generated method longer than the 8,000 bytes that the JVM compiles, so every row was interpreted.
    """
    plain = F.col(text).rlike(r"^\d{4}-\d{2}-\d{2}$")
    odd = F.get(F.transform(F.array(F.col(text)), odd_day), F.lit(0))
    return F.when(plain, F.col(text).try_cast("date")).otherwise(F.when(F.col(text).rlike(r"\d"), odd))


def typed(rows: DataFrame, text: str = "_day") -> DataFrame:
    """The rows with their day parsed, once, as `_parsed`; a written table."""
    return materialize(rows.withColumn("_parsed", parsed_day(text)), "typed")


def fill_typed(rows: DataFrame, out: str = "date") -> DataFrame:
    """Dates of typed rows; bad ones take the next good one, the tail the default date."""
    filled = next_valid(rows, "_parsed", "_filled")
    return (filled.withColumn(out, F.coalesce("_filled", F.lit(P.DEFAULT_DATE).cast("date")))
            .withColumn("_bad_date", F.col("_parsed").isNull()).drop("_parsed", "_filled"))


def fill_dates(df: DataFrame, text: str, out: str = "date") -> DataFrame:
    """Dates from text; bad ones take the next good one, the tail the default date."""
    return fill_typed(typed(df, text), out)


def google_cost_is_dollars(df: DataFrame) -> bool:
    """A plain `spend` header without any micros header holds dollars."""
    names = set(header_index(df))
    return "spend" in names and not names.intersection(GOOGLE_MICROS)


def first_present(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    index = header_index(df)
    return next((index[c] for c in candidates if c in index), None)


def _clip(c: Column) -> Column:
    return F.greatest(c, F.lit(0).cast(MONEY))


# The *_rows functions are one projection over the export, with the day still text
# in `_day`; the read_* ones have their dates.

def google_rows(df: DataFrame) -> DataFrame:
    cost = to_money("s_metrics_cost_micros")
    if not google_cost_is_dollars(df):
        # Micros are whole numbers: the shift by six digits keeps the decimal exact.
        cost = F.coalesce((F.col("s_metrics_cost_micros").try_cast("decimal(38,6)")
                           / F.lit(1000000)).try_cast(MONEY), F.lit(0).cast(MONEY))
    return standard_columns(df, GOOGLE).select(
        *ORDER_COLUMNS, F.col("s_segments_date").alias("_day"),
        F.lit(GOOGLE.channel).alias("channel"), F.col("s_campaign_id").alias("campaign_id"),
        F.coalesce("s_campaign_name", F.lit(GOOGLE.generic_name)).alias("campaign_name"),
        canonical_type("s_campaign_advertising_channel_type", True).alias("campaign_type"),
        cost.alias("spend"), to_money("s_metrics_conversions_value").alias("revenue"),
        to_number("s_metrics_clicks").alias("clicks"),
        to_number("s_metrics_impressions").alias("impressions"),
        to_number("s_metrics_conversions").alias("conversions"))


def bing_rows(df: DataFrame) -> DataFrame:
    return standard_columns(df, BING).select(
        *ORDER_COLUMNS, F.col("s_TimePeriod").alias("_day"),
        F.lit(BING.channel).alias("channel"), F.col("s_CampaignId").alias("campaign_id"),
        F.coalesce("s_CampaignName", F.lit(BING.generic_name)).alias("campaign_name"),
        canonical_type("s_CampaignType", False).alias("campaign_type"),
        to_money("s_Spend").alias("spend"), to_money("s_Revenue").alias("revenue"),
        to_number("s_Clicks").alias("clicks"), to_number("s_Impressions").alias("impressions"),
        to_number("s_Conversions").alias("conversions"))


def meta_counts_conversions(df: DataFrame) -> bool:
    """Whether the export has a column of conversions beside that of their value."""
    count_from = first_present(df, META_COUNT)
    return bool(count_from) and count_from != first_present(df, META_REVENUE)


def meta_rows(df: DataFrame, revenue_per_conversion: Column | None = None) -> DataFrame:
    """Without a count column conversions come from the given average value."""
    revenue_from = first_present(df, META_REVENUE)
    count_from = first_present(df, META_COUNT)
    # The sources are picked from the headers as they are, before any renaming.
    extra = {a: F.col(f"`{c}`").cast("string")
             for c, a in ((revenue_from, "x_revenue"), (count_from, "x_count")) if c}
    wide = standard_columns(df, META, extra)
    revenue = to_money("x_revenue" if revenue_from else "s_conversion")
    if meta_counts_conversions(df):
        conversions = to_number("x_count")
    else:
        per = (revenue_per_conversion if revenue_per_conversion is not None
               else F.lit(P.DEFAULT_REVENUE_PER_CONVERSION))
        conversions = revenue.cast("double") / per
    return wide.select(
        *ORDER_COLUMNS, F.col("s_date_start").alias("_day"),
        F.lit(META.channel).alias("channel"), F.col("s_campaign_id").alias("campaign_id"),
        F.coalesce("s_campaign_name", F.lit(META.generic_name)).alias("campaign_name"),
        F.lit("SOCIAL").alias("campaign_type"),
        to_money("s_spend").alias("spend"), revenue.alias("revenue"),
        to_number("s_clicks").alias("clicks"), to_number("s_impressions").alias("impressions"),
        conversions.alias("conversions"))


def read_google(df: DataFrame) -> DataFrame:
    """Google rows before clipping: fact columns, row order and `_bad_date`."""
    return fill_dates(google_rows(df), "_day").drop("_day")


def read_bing(df: DataFrame) -> DataFrame:
    return fill_dates(bing_rows(df), "_day").drop("_day")


def read_meta(df: DataFrame, revenue_per_conversion: Column | None = None) -> DataFrame:
    return fill_dates(meta_rows(df, revenue_per_conversion), "_day").drop("_day")


def clip_negative(rows: DataFrame) -> DataFrame:
    return rows.withColumns({m: _clip(F.col(m)) for m in ("spend", "revenue")})


def suspicious_rows(rows: DataFrame) -> DataFrame:
    """Much spend on nothing shown."""
    return rows.filter((F.col("spend") > 1000) & (F.col("impressions") == 0))


def spend_outliers(rows: DataFrame, factor: float = 3.0) -> DataFrame:
    """Rows that spend over `factor` times the 99th percentile of all rows."""
    limit = exact_percentile(rows, "spend", 0.99, out="_p99")
    return rows.filter(F.col("spend").cast("double") > scalar_of(limit, "_p99")["_p99"] * factor)


def revenue_per_conversion(rows: DataFrame) -> DataFrame:
    """One row: dollars for each conversion, the default when there are none."""
    rev, conv = F.sum("revenue").cast("double"), F.sum("conversions")
    return rows.agg(F.when(conv > 0, rev / conv)
                    .otherwise(F.lit(P.DEFAULT_REVENUE_PER_CONVERSION)).alias("per_conversion"))


def _ledger(counts: DataFrame, platform: str, checks: list[tuple[str, Column, float, str]]
            ) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(platform).alias("platform"), F.lit(name).alias("check"),
                 n.cast("long").alias("affected"), F.lit(float(penalty)).alias("penalty"),
                 F.lit(text).alias("message"))
        for name, n, penalty, text in checks])
    return (counts.select(F.explode(entries).alias("e")).select("e.*")
            .filter((F.col("affected") > 0) | (F.col("check") == "rows_read")))


def audit_counts(bad_date: Column) -> list[Column]:
    """What the audits count, as aggregates."""
    neg_spend, neg_rev = F.col("spend") < 0, F.col("revenue") < 0
    return [F.count("*").alias("n"), F.count_if(bad_date).alias("bad_dates"),
            F.count_if(neg_spend).alias("neg_spend"), F.count_if(neg_rev).alias("neg_revenue"),
            F.count_if(neg_spend | neg_rev).alias("neg_any"),
            F.count_if((F.col("spend") > 1000) & (F.col("impressions") == 0)).alias("suspicious")]


def audit(raw: DataFrame | list[DataFrame], rows: DataFrame, spec: ExportSpec, factor: float = 3.0,
          counts: DataFrame | None = None) -> DataFrame:
    """Ledger of one platform: one pass over its rows, one aggregate row, unfolded.

    `rows` are its *_rows, of all its parts: a date is bad if its text does not parse, so no
    date has to be filled for the count. A column that any part lacks is charged twice, when
    it is not found and when it is imputed, but once for all parts. `counts`: the row of
    `audit_counts` over `rows`, if it is there already.
    """
    parts = raw if isinstance(raw, list) else [raw]
    bad = (F.col("_parsed") if "_parsed" in rows.columns else parsed_day("_day")).isNull()
    counts = rows.agg(*audit_counts(bad)) if counts is None else counts
    if spec is META:
        counts = attach(counts, count_over_percentile(clip_negative(rows), "spend", 0.99, factor), "above")
    checks = [("rows_read", F.col("n"), 0.0, "rows read")]
    lacking = {s for part in parts for s, actual in resolve_aliases(part, spec).items() if actual is None}
    for standard in spec.columns:
        if standard in lacking:
            checks.append((f"column_missing:{standard}", F.lit(1), 5.0,
                           f"expected column {standard} not found"))
            checks.append((f"column_imputed:{standard}", F.lit(1), 5.0,
                           f"column {standard} filled with a default"))
    checks.append(("bad_dates", F.col("bad_dates"), 2.0, "dates that did not parse"))
    if spec is GOOGLE:
        checks += [("negative_spend", F.col("neg_spend"), 3.0, "negative spend set to 0"),
                   ("negative_revenue", F.col("neg_revenue"), 3.0, "negative revenue set to 0"),
                   ("suspicious", F.col("suspicious"), 4.0, "high spend without impressions")]
    else:
        checks.append(("negative_money", F.col("neg_any"), 3.0, "negative amounts set to 0"))
    if spec is META:
        checks.append(("spend_outliers", F.col("above"), 2.0, f"spend over {factor:g} x p99"))
    return _ledger(counts, spec.platform, checks)


def corrupt_lines(raw: DataFrame, platform: str) -> DataFrame:
    """Ledger row for lines that did not fit the header (noted, not charged)."""
    if CORRUPT not in raw.columns:
        return raw.sparkSession.createDataFrame([], LEDGER_SCHEMA)
    # A data column takes part, as a scan of the corrupt column alone is refused.
    data = next(c for c in raw.columns if c not in (*ORDER_COLUMNS, CORRUPT))
    parsed = F.length(F.coalesce(F.col(f"`{data}`"), F.lit(""))) >= 0
    return _ledger(raw.agg(F.count_if(F.col(CORRUPT).isNotNull() & parsed).alias("n")), platform,
                   [("corrupt_lines", F.col("n"), 0.0, "lines that did not fit the header")])


def critical_warnings(ledger: DataFrame, threshold: float = 5.0) -> DataFrame:
    return ledger.filter(F.col("penalty") >= threshold)


def quality_score(ledger: DataFrame) -> DataFrame:
    """One row: 100 less all penalties, kept within 10..100, one digit."""
    lost = F.coalesce(F.sum("penalty"), F.lit(0.0))
    return ledger.agg(
        F.bround(clamp(F.lit(100.0) - lost, 10.0, 100.0), 1).alias("quality_score"),
        F.count_if(F.col("penalty") >= 5.0).alias("critical_warnings"))


def unify(exports: list[DataFrame]) -> DataFrame:
    """All platforms' rows in one table of fact columns."""
    out = exports[0].select(*FACT_COLUMNS)
    for rows in exports[1:]:
        out = out.unionByName(rows.select(*FACT_COLUMNS))
    return out


Export = DataFrame | list[DataFrame] | None


def _parts(export: Export) -> list[DataFrame]:
    return [] if export is None else export if isinstance(export, list) else [export]


def typed_exports(google: Export = None, bing: Export = None, meta: Export = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The typed rows of all exports, with their day parsed, written once in one job.

    `_estimate` marks rows whose conversions are still to be estimated. `columns` are those to be
    written beside the parsed day, all if not given. Without any export it raises.
    """
    made = [make(raw).withColumn("_estimate", F.lit(False)) for export, make in ((google, google_rows), (bing, bing_rows)) for raw in _parts(export)]
    made += [meta_rows(raw).withColumn("_estimate", F.lit(not meta_counts_conversions(raw))) for raw in _parts(meta)]
    if not made:
        raise ValueError("no export could be ingested")
    rows = reduce(DataFrame.unionByName, made)
    if columns is None:
        return typed(rows)
    return materialize(rows.select(*columns, parsed_day("_day").alias("_parsed")), "typed")


def typed_facts(rows: DataFrame) -> DataFrame:
    """Facts of typed rows: conversions estimated from what one is worth on the other platforms, dates filled, amounts clipped."""
    others = clip_negative(rows.filter(F.col("channel") != META.channel)).select("revenue", "conversions")
    per = scalar_of(revenue_per_conversion(others), "per_conversion")["per_conversion"]
    whole = rows.withColumn("conversions", F.when(F.col("_estimate"), F.col("revenue").cast("double") / per).otherwise(F.col("conversions")))
    return unify([clip_negative(fill_typed(whole.drop("_estimate")))])


def typed_ledger(rows: DataFrame, facts: DataFrame, google: Export = None, bing: Export = None, meta: Export = None) -> DataFrame:
    """The ledger of all exports: one aggregate over their typed rows, and the repeated keys of the facts."""
    counts = materialize(rows.groupBy("channel").agg(*audit_counts(F.col("_parsed").isNull())), "audit")
    ledger = [audit(_parts(export), rows.filter(F.col("channel") == spec.channel), spec, counts=counts.filter(F.col("channel") == spec.channel))
              for spec, export in ((GOOGLE, google), (BING, bing), (META, meta)) if _parts(export)]
    return reduce(DataFrame.unionByName, ledger).unionByName(duplicate_audit(facts))


def ingest(google: Export = None, bing: Export = None, meta: Export = None
           ) -> tuple[DataFrame, DataFrame]:
    """(facts, ledger) of the raw exports there are; without any it raises.

    A platform's export may come in parts whose headers differ; it is audited once.
    """
    rows = typed_exports(google, bing, meta)
    facts = typed_facts(rows)
    return facts, typed_ledger(rows, facts, google, bing, meta)


#: What the audits read of a row, beside its parsed day.
AUDITED = (*ORDER_COLUMNS, "channel", "campaign_id", "spend", "revenue", "impressions")


def ingest_ledger(google: Export = None, bing: Export = None, meta: Export = None) -> DataFrame:
    """The ledger of `ingest` for those who want no facts: the same audits over every row.

    Names, types, clicks and conversions, which no audit reads, are neither parsed nor written.
    """
    rows = typed_exports(google, bing, meta, AUDITED)
    return typed_ledger(rows, fill_typed(rows), google, bing, meta)


def duplicate_audit(facts: DataFrame) -> DataFrame:
    """Ledger row (3 points, once) when dates, channels and ids repeat; only these columns are grouped."""
    keys = facts.groupBy("date", "channel", "campaign_id").agg(F.count("*").alias("n"))
    return _ledger(keys.agg(F.sum(F.col("n") - 1).alias("duplicates")), "all", [
        ("duplicates", F.col("duplicates"), 3.0, "repeated date, channel and campaign summed")])


MEASURES = ("spend", "revenue", "clicks", "impressions", "conversions")
FACT_KEYS = ("date", "channel", "campaign_id", "campaign_name", "campaign_type")


def merge_duplicates(facts: DataFrame) -> DataFrame:
    """One row per date, channel and campaign (id, name, type), measures summed.

    Rows with a null key are kept. `source_rows` tells how many went in.
    """
    return facts.groupBy(*FACT_KEYS).agg(
        *[F.sum(m).alias(m) for m in MEASURES], F.count("*").alias("source_rows"))


def duplicate_count(merged: DataFrame) -> DataFrame:
    """One row: how many source rows repeat an earlier date, channel and id."""
    keys = merged.groupBy("date", "channel", "campaign_id").agg(F.sum("source_rows").alias("n"))
    return keys.agg(F.sum(F.col("n") - 1).alias("duplicates"))


def duplicate_rows(facts: DataFrame, order: list[str]) -> DataFrame:
    """The rows after the first of each date, channel and id.

    The first of a key is an aggregate, joined back: a key with very many rows is
    streamed, and split by the adaptive join, instead of being held in a window.
    `order` must tell rows apart.
    """
    keys = ["date", "channel", "campaign_id"]
    place = F.struct(*order)
    first = facts.groupBy(*keys).agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    again = first.filter("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "_first")
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = eq if same is None else same & eq
    return facts.join(again, same).filter(place > F.col("_first")).select(*facts.columns)


def validation_summary(facts: DataFrame) -> DataFrame:
    """One row of totals, date range, portfolio roas and rows for each channel."""
    by_channel = facts.groupBy("channel").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.sum("spend").alias("s"), F.sum("revenue").alias("r"))
    spend, revenue = F.sum("s").cast("double"), F.sum("r").cast("double")
    return by_channel.agg(
        F.sum("n").alias("total_records"), F.count("*").alias("channels"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "n"))))
        .alias("channel_record_counts"),
        F.date_format(F.min("lo"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("hi"), "yyyy-MM-dd").alias("max_date"),
        spend.alias("total_spend"), revenue.alias("total_revenue"),
        (revenue / (spend + P.EPS)).alias("overall_roas"))
