"""Spend-response curves, budget simulation and allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roaskit import params as P
from roaskit.functions.attach import attach
from roaskit.functions.scalars import clamp, guarded_ratio
from roaskit.operators.ordered import running_totals
from roaskit.sources.storage import materialize


def monthly_channel(cube: DataFrame, positive_only: bool = True) -> DataFrame:
    """channel, month, spend, revenue; months without spend or revenue are left out."""
    rows = cube.groupBy("channel", F.trunc("date", "month").alias("month")).agg(
        F.sum("spend").cast("double").alias("spend"),
        F.sum("revenue").cast("double").alias("revenue"))
    return rows.filter("spend > 0 and revenue > 0") if positive_only else rows


def known_beta(channel: str | Column = "channel") -> Column:
    c = F.col(channel) if isinstance(channel, str) else channel
    out = F.lit(P.DEFAULT_BETA)
    for name, beta in P.RESPONSE_BETA.items():
        out = F.when(c == name, F.lit(beta)).otherwise(out)
    return out


def fit_response_curves(cube: DataFrame) -> DataFrame:
    """channel, alpha, beta, base_roas, fit_cv of revenue = alpha * spend^beta a month.

    Everything comes from channel-month rows. A channel without a usable month is
    set from its roas at a spend of 10,000; fewer than two months give the default
    spread.
    """
    months = monthly_channel(cube, positive_only=False)
    usable = (F.col("spend") > 0) & (F.col("revenue") > 0)
    whole = Window.partitionBy("channel")
    beta = known_beta()
    n = F.count_if(usable).over(whole)
    mean_s = F.avg(F.when(usable, F.col("spend"))).over(whole)
    mean_r = F.avg(F.when(usable, F.col("revenue"))).over(whole)
    rows = months.withColumns({"beta": beta, "_n": n, "_ms": mean_s, "_mr": mean_r,
                               "_s": F.sum("spend").over(whole),
                               "_r": F.sum("revenue").over(whole)})
    roas = F.col("_r") / (F.col("_s") + P.EPS)
    alpha = F.when(F.col("_n") > 0, F.col("_mr") / F.pow("_ms", "beta")).otherwise(
        roas * F.pow(F.lit(10000.0), F.lit(1.0) - F.col("beta")))
    rows = rows.withColumns({"base_roas": roas, "alpha": alpha})
    fit = F.col("alpha") * F.pow("spend", "beta")
    gap = F.when(usable, (F.col("revenue") - fit) / (fit + P.EPS))
    return rows.groupBy("channel").agg(
        F.max("alpha").alias("alpha"), F.max("beta").alias("beta"),
        F.max("base_roas").alias("base_roas"),
        F.when(F.max("_n") >= 2, clamp(F.stddev_pop(gap), 0.0, P.MAX_FIT_CV))
        .otherwise(F.lit(P.DEFAULT_FIT_CV)).alias("fit_cv"))


def run_rate_spend(cube: DataFrame, days: int = 30) -> DataFrame:
    """channel, spend of an average 30 days; channels without spend get the others' mean."""
    by_day = cube.groupBy("channel", "date").agg(F.sum("spend").alias("spend"))
    n = by_day.select("date").distinct().agg(F.count("*").alias("_days"))
    rate = attach(by_day.groupBy("channel").agg(F.sum("spend").cast("double").alias("s")), n)
    rate = rate.select("channel", (F.col("s") / F.col("_days") * days).alias("spend"))
    good = F.col("spend") > 0
    mean = rate.agg(F.avg(F.when(good, F.col("spend"))).alias("_mean"))
    return attach(rate, mean).select("channel", F.when(good, F.col("spend")).otherwise(
        F.coalesce("_mean", F.lit(P.DEFAULT_RUN_RATE))).alias("spend"))


def _pct(pcts: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, pct in pcts.items():
        out = F.when(F.col("channel") == name, F.lit(float(pct))).otherwise(out)
    return out


def simulate_budget(base: DataFrame, curves: DataFrame, pcts: dict[str, float]) -> DataFrame:
    """What each channel brings when its spend moves by its percentage.

    channel, spend, revenue, roas, revenue_change_pct; the row with channel null is
    the total. `pcts` holds the caller's few changes; unnamed channels stay.
    """
    rows = base.select("channel", F.col("spend").alias("_old")).join(
        curves.select("channel", "alpha", "beta"), "channel", "left")
    a = F.coalesce("alpha", F.lit(P.UNKNOWN_ALPHA))
    b = F.coalesce("beta", F.lit(P.UNKNOWN_BETA))
    new = F.greatest(F.lit(P.MIN_SIMULATED_SPEND), F.col("_old") * (1.0 + _pct(pcts) / 100.0))
    rows = rows.select("channel", new.alias("spend"), (a * F.pow(new, b)).alias("revenue"),
                       (a * F.pow("_old", b)).alias("_was"))
    g = F.grouping("channel")
    s, r, w = F.sum("spend"), F.sum("revenue"), F.sum("_was")
    return rows.rollup("channel").agg(
        s.alias("spend"), r.alias("revenue"),
        F.when(g == 1, r / (s + P.EPS)).otherwise(r / s).alias("roas"),
        F.when(g == 0, (r - w) / (w + P.EPS) * 100.0).alias("revenue_change_pct"))


def allocation_bounds(curves: DataFrame, budget: float, lower_share: float = P.ALLOCATION_LOWER
                      ) -> DataFrame:
    """curves with `lower`, `upper` spend: weak channels are kept to a tight ceiling.

    Lower is `lower_share` of the budget for every channel. Where these alone would
    take the whole budget nothing is left to allocate, and an error says so: give a
    smaller share. Upper is never below lower.
    """
    if budget <= 0:
        raise ValueError(f"budget must be positive, got {budget}")
    count = curves.count()
    if count * lower_share >= 1:
        raise ValueError(f"lower_share {lower_share} of {count} channels takes the whole budget; give less than {1 / count:.6f}")
    n = curves.agg(F.count("*").alias("_n"))
    rows = attach(curves, n).withColumn("_eq", F.col("alpha") * F.pow(
        F.lit(float(budget)) / F.col("_n"), F.col("beta")))
    total = rows.agg(F.sum("_eq").alias("_total"))
    share = F.col("_eq") / F.col("_total")
    tight = clamp(share * budget * 2.5, budget * 0.02, budget * 0.15)
    return attach(rows, total).select(
        *curves.columns, share.alias("equal_split_share"),
        F.lit(float(budget * lower_share)).alias("lower"),
        F.greatest(F.lit(float(budget * lower_share)), F.when(share < P.ALLOCATION_SMALL_SHARE, tight)
                   .otherwise(F.lit(budget * P.ALLOCATION_WIDE))).alias("upper"))


def allocation_ladder(bounds: DataFrame, budget: float, steps: int = P.ALLOCATION_STEPS
                      ) -> DataFrame:
    """channel, step, add_spend, add_revenue, marginal: spend above the lower bound in
    increments of budget / steps, and a smaller last one up to the upper bound."""
    inc = budget / steps
    n = F.ceil((F.col("upper") - F.col("lower")) / inc - 1e-9).cast("int")
    rows = bounds.filter(n >= 1).withColumn("step", F.explode(F.sequence(F.lit(1), n)))
    lo = F.col("lower") + (F.col("step") - 1) * inc
    hi = F.least(F.col("lower") + F.col("step") * inc, F.col("upper"))
    gain = F.col("alpha") * (F.pow(hi, F.col("beta")) - F.pow(lo, F.col("beta")))
    return rows.select("channel", "step", (hi - lo).alias("add_spend"),
                       gain.alias("add_revenue"), (gain / (hi - lo)).alias("marginal"))


def allocate_budget(curves: DataFrame, budget: float, target_roas: float,
                    steps: int = P.ALLOCATION_STEPS, lower_share: float = P.ALLOCATION_LOWER
                    ) -> DataFrame:
    """channel, allocated_spend, expected_revenue, expected_roas, budget_share.

    The curves are concave, so taking increments by falling marginal return gives
    the most revenue at every total. The longest prefix of that order that keeps
    to the budget and the roas floor is the answer; if none does, the prefix with
    the highest roas. Prefix sums run over ranges of the order, not in one task.
    The increments and their prefixes are read several times and so written once.
    """
    bounds = materialize(allocation_bounds(curves, budget, lower_share), "bounds")
    base = bounds.agg(F.sum("lower").alias("_s0"),
                      F.sum(F.col("alpha") * F.pow("lower", "beta")).alias("_r0"))
    ladder = materialize(allocation_ladder(bounds, budget, steps), "ladder")
    walk = running_totals(ladder, [-F.round("marginal", 9), F.col("channel"), F.col("step")],
                          {"cum_spend": "add_spend", "cum_revenue": "add_revenue"},
                          rank="position")
    walk = materialize(attach(walk, base).select(
        "channel", "position", "add_spend", (F.col("_s0") + F.col("cum_spend")).alias("spend"),
        (F.col("_r0") + F.col("cum_revenue")).alias("revenue")), "walk")
    start = base.select(F.lit(0).cast("long").alias("position"), F.col("_s0").alias("spend"),
                        F.col("_r0").alias("revenue"))
    prefixes = walk.select("position", "spend", "revenue").unionByName(start).withColumn(
        "roas", F.col("revenue") / (F.col("spend") + P.EPS))
    fits = F.col("spend") <= F.lit(budget * (1 + 1e-9))
    ok = fits & (F.col("roas") >= target_roas)
    pick = prefixes.agg(
        F.coalesce(F.max(F.when(ok, F.col("position"))),
                   F.max_by(F.when(fits, F.col("position")),
                            F.when(fits, F.struct("roas", "position")))).alias("_cut"))
    taken = (attach(walk.select("channel", "position", "add_spend"), pick).filter("position <= _cut")
             .groupBy("channel").agg(F.sum("add_spend").alias("_more")))
    spend = F.col("lower") + F.coalesce("_more", F.lit(0.0))
    rows = bounds.join(taken, "channel", "left").withColumn("allocated_spend", spend)
    rows = rows.withColumn("expected_revenue", F.col("alpha") * F.pow("allocated_spend", "beta"))
    total = rows.agg(F.sum("allocated_spend").alias("_sum"))
    return attach(rows, total).select(
        "channel", "allocated_spend", "expected_revenue",
        (F.col("expected_revenue") / F.col("allocated_spend")).alias("expected_roas"),
        (F.col("allocated_spend") / F.col("_sum") * 100.0).alias("budget_share"), "fit_cv")


#: Multipliers tried at once by `multiplier_for`, and how often their range is narrowed to the gap between two.
TRIED, ROUNDS = 512, 5


def spend_at(multiplier: Column) -> Column:
    """The spend at which a channel's marginal return falls to the multiplier, kept to its bounds; the lower one if it returns nothing."""
    free = F.pow(multiplier / (F.col("alpha") * F.col("beta")), F.lit(1.0) / (F.col("beta") - F.lit(1.0)))
    return F.when(F.col("alpha") > 0, F.greatest(F.col("lower"), F.least(F.col("upper"), free))).otherwise(F.col("lower"))


def multiplier_for(bounds: DataFrame, enough: Column, label: str) -> DataFrame:
    """One row, lo and hi: the ends of the narrow gap of multipliers at which `enough` turns from true to false.

    `enough` is on the totals `spend`, `revenue` and on `multiplier`, and holds for small
    multipliers. Each round is one aggregate over the channels, with partial sums: a channel is
    unfolded to `TRIED` multipliers, whatever the number of channels. What comes back is one row.
    """
    marginal = F.when(F.col("alpha") > 0, F.col("alpha") * F.col("beta"))
    ends = bounds.agg(F.log(F.min(marginal * F.pow("upper", F.col("beta") - 1.0))).alias("lo"),
                      F.log(F.max(marginal * F.pow("lower", F.col("beta") - 1.0))).alias("hi"))
    gap = materialize(ends.select((F.coalesce("lo", F.lit(0.0)) - 1e-6).alias("lo"), (F.coalesce("hi", F.lit(0.0)) + 1e-6).alias("hi")), label)
    for _ in range(ROUNDS):
        step = (F.col("hi") - F.col("lo")) / TRIED
        rows = attach(bounds, gap).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(TRIED))))
        rows = rows.withColumn("at", F.col("lo") + F.col("k") * step).withColumn("_s", spend_at(F.exp("at")))
        totals = rows.groupBy("k", "at").agg(F.sum("_s").alias("spend"), F.sum(F.col("alpha") * F.pow("_s", F.col("beta"))).alias("revenue"))
        good = totals.withColumn("multiplier", F.exp("at")).withColumn("ok", enough)
        lo = F.coalesce(F.max(F.when(F.col("ok"), F.col("at"))), F.min("at"))
        hi = F.coalesce(F.min(F.when(~F.col("ok"), F.col("at"))), F.max("at"))
        gap = materialize(good.agg(lo.alias("lo"), hi.alias("hi")), label)
    return gap.select(F.exp("lo").alias("lo"), F.exp("hi").alias("hi"))


def allocate_exact(curves: DataFrame, budget: float, target_roas: float, lower_share: float = P.ALLOCATION_LOWER) -> DataFrame:
    """channel, allocated_spend, expected_revenue, expected_roas, budget_share, fit_cv, without a grid.

    Of all ways to spend a total, the best gives every channel that is not at a bound the same
    marginal return, the multiplier; the total falls as it rises. The answer is the largest
    total within the budget whose roas is at the target or over it. Along these totals revenue
    is concave, so roas rises as long as the multiplier is above it and falls after that:
    the peak is where both meet. If not even the peak is at the target, the peak is the answer.
    """
    bounds = materialize(allocation_bounds(curves, budget, lower_share), "bounds")
    roas = F.col("revenue") / F.col("spend")
    within = multiplier_for(bounds, F.col("spend") > budget, "within").select(F.col("hi").alias("_within"))
    floor = multiplier_for(bounds, (roas < target_roas) & (F.col("multiplier") <= roas), "floor").select(F.col("hi").alias("_floor"))
    got = attach(attach(bounds, within), floor).withColumn("allocated_spend", spend_at(F.greatest("_within", "_floor")))
    got = got.withColumn("expected_revenue", F.col("alpha") * F.pow("allocated_spend", F.col("beta")))
    total = got.agg(F.sum("allocated_spend").alias("_sum"))
    return attach(got, total).select(
        "channel", "allocated_spend", "expected_revenue", (F.col("expected_revenue") / F.col("allocated_spend")).alias("expected_roas"),
        (F.col("allocated_spend") / F.col("_sum") * 100.0).alias("budget_share"), "fit_cv")


def allocation_total(allocation: DataFrame, budget: float, target_roas: float) -> DataFrame:
    """One row: totals, 80 % band from the curves' spread, and whether the target is met."""
    s, r = F.sum("allocated_spend"), F.sum("expected_revenue")
    sums = allocation.agg(s.alias("recommended_total_spend"), r.alias("expected_total_revenue"),
                          F.sum(F.pow("expected_revenue", F.lit(2.0))
                                * F.pow("fit_cv", F.lit(2.0))).alias("_var"))
    roas = F.col("expected_total_revenue") / F.col("recommended_total_spend")
    cv = clamp(F.when(F.col("expected_total_revenue") > 0,
                      F.sqrt("_var") / F.col("expected_total_revenue"))
               .otherwise(F.lit(0.15)), 0.04, 0.30)
    band = F.lit(P.Z_80) * cv
    rows = sums.withColumns({"expected_total_roas": roas, "band": band})
    met = F.col("expected_total_roas") >= target_roas
    note = F.format_string(
        f"Target ROAS {target_roas}x is out of reach within ${budget:,.0f}: the best found is "
        "%.2fx. Lower the target or the budget.", "expected_total_roas")
    return rows.select(
        F.lit(float(budget)).alias("max_budget"), F.lit(float(target_roas)).alias("target_roas"),
        "recommended_total_spend", "expected_total_revenue", "expected_total_roas",
        *[(F.col(c) * f).alias(f"{n}_{q}")
          for n, c in (("revenue", "expected_total_revenue"), ("roas", "expected_total_roas"))
          for q, f in (("p10", 1.0 - F.col("band")), ("p50", F.lit(1.0)),
                       ("p90", 1.0 + F.col("band")))],
        met.alias("target_achievable"), F.when(~met, note).alias("target_achievement_note"))


def allocation_report(allocation: DataFrame) -> DataFrame:
    """Channels and, as the row with channel null, their total."""
    s, r = F.sum("allocated_spend"), F.sum("expected_revenue")
    return allocation.rollup("channel").agg(
        s.alias("allocated_spend"), r.alias("expected_revenue"), (r / s).alias("expected_roas"),
        F.sum("budget_share").alias("budget_share"))


def marginal_roas(cube: DataFrame, uplift: float = 0.20) -> DataFrame:
    """channel, roas, marginal_roas, extra_spend, extra_revenue of `uplift` more spend.

    On a power curve the marginal return is beta times the average one.
    """
    g = cube.groupBy("channel").agg(F.sum("spend").cast("double").alias("spend"),
                                    F.sum("revenue").cast("double").alias("revenue"))
    roas = guarded_ratio("revenue", "spend")
    beta = known_beta()
    return g.select("channel", roas.alias("roas"), (roas * beta).alias("marginal_roas"),
                    (F.col("spend") * uplift).alias("extra_spend"),
                    (F.col("spend") * uplift * roas * beta).alias("extra_revenue"))
