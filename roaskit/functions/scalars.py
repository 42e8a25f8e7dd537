"""Scalar expressions: guarded ratios, calendar parts, error measures, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roaskit import params as P

# Season code 0..3 -> name.
SEASON_NAMES = ("WINTER", "SPRING", "SUMMER", "FALL")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return as_col(c).cast("double")


def guarded_ratio(num: str | Column, den: str | Column, eps: float = P.EPS) -> Column:
    """num / (den + eps): never divides by zero for non-negative measures."""
    return dbl(num) / (dbl(den) + F.lit(eps))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, and 0 where the denominator is practically zero."""
    n, d = dbl(num), dbl(den)
    return F.when(F.abs(d) < 1e-9, F.lit(0.0)).otherwise(n / d)


def clamp(c: str | Column, low: float | Column | None = None,
          high: float | Column | None = None) -> Column:
    """Within [low, high]; null stays null (greatest and least alone would skip it)."""
    value = out = as_col(c)
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(value.isNotNull(), out)


def season_code(month: str | Column) -> Column:
    """0 for Dec-Feb, then one per quarter of the meteorological year."""
    return F.floor(F.pmod(as_col(month), F.lit(12)) / 3).cast("int")


def season_name(month: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEASON_NAMES]), season_code(month) + 1)


def calendar_columns(date: str | Column = "date") -> dict[str, Column]:
    """The six calendar features (weekday counts from Monday = 0)."""
    d = as_col(date)
    return {
        "month": F.month(d),
        "quarter": F.quarter(d),
        "week": F.weekofyear(d),
        "day_of_week": F.weekday(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "season_encoded": season_code(F.month(d)),
    }


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns({**calendar_columns(date), "season": season_name(F.month(date))})


def ape(actual: str | Column, predicted: str | Column) -> Column:
    return safe_ratio(F.abs(dbl(predicted) - dbl(actual)), F.abs(dbl(actual))) * 100.0


def smape(actual: str | Column, predicted: str | Column) -> Column:
    a, p = dbl(actual), dbl(predicted)
    return safe_ratio(F.abs(p - a) * 200.0, F.abs(a) + F.abs(p))


def wape(actual: str | Column, predicted: str | Column) -> Column:
    """Aggregate: 100 x total absolute error / total absolute actual."""
    a, p = dbl(actual), dbl(predicted)
    return safe_ratio(F.sum(F.abs(a - p)), F.sum(F.abs(a))) * 100.0


def rmse(error: str | Column) -> Column:
    return F.sqrt(F.avg(F.pow(dbl(error), F.lit(2.0))))


def normalize_name(text: str | Column) -> Column:
    """Header spelling: lower case, blanks and hyphens to one underscore, ends trimmed."""
    s = F.regexp_replace(F.lower(as_col(text)), "[ -]", "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")


#: Amounts of money as exports carry them.
MONEY = "decimal(38,6)"


def finite(c: str | Column) -> Column:
    """Text as a double; null for what is no number, and for NaN and infinities."""
    x = as_col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def to_number(c: str | Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def to_money(c: str | Column) -> Column:
    """Text to dollars, exact to the micro; what is no finite number counts as zero."""
    return F.coalesce(finite(c).try_cast(MONEY), F.lit(0).cast(MONEY))


def canonical_type(c: str | Column, collapse_blanks: bool) -> Column:
    """Upper snake case: PerformanceMax -> PERFORMANCE_MAX; missing -> SEARCH."""
    s = F.regexp_replace(F.coalesce(as_col(c), F.lit("SEARCH")), "(?<=[a-z])(?=[A-Z])", "_")
    if collapse_blanks:
        s = F.regexp_replace(s, r"[\s\-]+", "_")
    return F.upper(s)


def confidence_pct(p10: str | Column, p50: str | Column, p90: str | Column) -> Column:
    """Width of the interval against its middle, as 35..97 %; 40 when there is no middle."""
    lo, mid, hi = dbl(p10), dbl(p50), dbl(p90)
    # floor(x + 0.5): halves go up, also below zero.
    pct = F.floor(F.lit(100.0) - (hi - lo) / mid * 28.0 + 0.5)
    return F.when(mid <= 0, F.lit(40)).otherwise(clamp(pct, F.lit(35), F.lit(97))).cast("int")


def confidence_label(pct: str | Column, p50: str | Column) -> Column:
    p = as_col(pct)
    return (F.when(dbl(p50) <= 0, F.lit("Low")).when(p >= 80, F.lit("High"))
            .when(p >= 60, F.lit("Medium")).otherwise(F.lit("Low")))


def money_text(c: str | Column) -> Column:
    """$1,234,567"""
    return F.concat(F.lit("$"), F.format_number(dbl(c), 0))


def times_text(c: str | Column) -> Column:
    """4.25x"""
    return F.concat(F.format_string("%.2f", dbl(c)), F.lit("x"))


def millions_text(c: str | Column, digits: int = 2) -> Column:
    """$1.23M"""
    return F.concat(F.lit("$"), F.format_string(f"%.{digits}f", dbl(c) / 1e6), F.lit("M"))


def compact_money_text(c: str | Column) -> Column:
    """Millions with one digit from a million up, whole dollars below."""
    return F.when(dbl(c) >= 1e6, millions_text(c, 1)).otherwise(money_text(c))


def strip_markdown(text: str | Column) -> Column:
    """Plain prose out of lightly marked-up text."""
    # The marks to take off, in the order they come off.
    marks = (
        (r"\*\*(.+?)\*\*", "$1"),
        (r"__(.+?)__", "$1"),
        (r"(?<!\w)\*(?!\s)(.+?)(?<!\s)\*(?!\w)", "$1"),
        (r"(?<!\w)_(?!\s)(.+?)(?<!\s)_(?!\w)", "$1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^\s*[-*•]\s+", ""),
        (r"(?m)^\s*\d+\.\s+", ""),
        (r"\n+", " "),
        (r" {2,}", " "),
    )
    s = as_col(text)
    # U: letters and blanks of all scripts; d: a line ends at \n only.
    for pattern, plain in marks:
        s = F.regexp_replace(s, "(?Ud)" + pattern, plain)
    return F.regexp_replace(s, r"(?Ud)^\s+|\s+\z", "")


# Ordered intents. Each is a list of word groups; a text has the
# intent when every group has a word in it.
INTENTS = (
    ("revenue_drop", (
        ("why", "reason", "cause", "explain"),
        ("decrease", "decreasing", "drop", "down", "soft", "decline", "lower", "fell",
         "falling", "worse", "underperform"))),
    ("best_channel", (
        ("which channel", "best channel", "top channel", "top driver", "most growth",
         "highest roas", "performing channel", "leading channel"),)),
    ("meta_scale", (
        ("meta", "facebook"),
        ("increase", "scale", "raise", "boost", "more", "spend", "budget"))),
    ("google", (
        ("google",),
        ("increase", "scale", "performance", "roas", "spend", "budget", "how"))),
    ("bing", (("bing", "microsoft"),)),
    ("forecast", (
        ("forecast", "predict", "expect", "future", "30 day", "60 day", "90 day", "30-day",
         "60-day", "90-day", "next month", "next quarter", "projection", "outlook",
         "revenue next"),)),
    ("budget", (
        ("budget", "allocat", "optimiz", "how much should", "invest", "distribute", "split",
         "recommend"),)),
    ("roas", (("roas", "return on ad", "efficiency"),)),
    ("risk", (("risk", "concern", "worry", "volatile", "uncertainty", "danger"),)),
    ("campaign_type", (
        ("campaign type", "pmax", "performance max", "remarketing", "branded", "non-brand",
         "search campaign", "social campaign"),)),
)


def tag_intent(text: str | Column) -> Column:
    """First intent whose words the text has, else general."""
    low = F.lower(as_col(text))
    out = None
    for name, groups in INTENTS:
        hit = None
        for words in groups:
            has = low.rlike("|".join(words))
            hit = has if hit is None else (hit & has)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("general"))
