"""Budget posteriors, rules, constraints and allocation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.expr import fixed, once
from spendlens.functions.skew import ordered_scan, with_totals
from spendlens.operators.normalize import kpis, temporal_features

c = F.col

# Decision thresholds of the two rule sets and the change limits.
PAUSE_BELOW, LOW_BELOW, HIGH_ABOVE = 0.5, 1.0, 3.0
MIN_BUDGET, MAX_INCREASE, MAX_DECREASE = 10.0, 2.0, 0.5
DRAWS = 1000


def posterior(history: DataFrame) -> DataFrame:
    """Beta(1 + conversions, 1 + clicks − conversions) folded over all history."""
    g = history.groupBy("campaign_id").agg(F.sum("conversions").alias("k"), F.sum("clicks").alias("n"))
    return g.select("campaign_id", (c("k") + 1.0).alias("alpha"), (c("n") - c("k") + 1.0).alias("beta"))


TRIES = 12  # a Gamma candidate is refused less than once in twenty times


def gamma_draw(shape: Column, key: Column) -> Column:
    """A Gamma draw for a shape of 1 or more, out of the key's text alone: the same on any engine and in any partitioning.

    Each try takes three uniforms from one md5 of key and try: two make a normal number, its cube a candidate, the third accepts it.
    """
    d = shape - 1 / 3.0

    def attempt(i: Column) -> Column:
        unit = lambda h, at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
        x = lambda h: F.sqrt(F.log(unit(h, 1)) * -2.0) * F.cos(unit(h, 9) * (2 * math.pi))
        parts = F.transform(F.array(F.md5(F.concat_ws(":", key, i.cast("string")))), lambda h: F.struct(x(h).alias("x"), unit(h, 17).alias("u")))
        cubed = F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["u"].alias("u"), F.pow(p["x"] / F.sqrt(d * 9.0) + 1.0, F.lit(3.0)).alias("v")))
        kept = F.transform(cubed, lambda p: F.when((p["v"] > 0) & (F.log(p["u"]) < p["x"] * p["x"] * 0.5 + d - d * p["v"] + d * F.log(p["v"])), d * p["v"]))
        return F.element_at(kept, 1)

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda got, i: F.coalesce(got, attempt(i))), d)


def beta_draw(alpha: Column, beta: Column, key: Column) -> Column:
    """A Beta draw (both parameters 1 or more) out of the key's text."""
    a, b = gamma_draw(alpha, F.concat(key, F.lit(":a"))), gamma_draw(beta, F.concat(key, F.lit(":b")))
    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] / (p["a"] + p["b"])), 1)


def draw_key(*parts: Column) -> Column:
    """The counter of a draw: run, campaign and the number of the draw."""
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def allocation_scores(post: DataFrame, group: str, method: str = "mean", run: int = 0) -> DataFrame:
    """Posterior mean or one draw per campaign, divided by the group's total."""
    score = c("alpha") / (c("alpha") + c("beta")) if method == "mean" else beta_draw(c("alpha"), c("beta"), draw_key(F.lit(run), c("campaign_id"), F.lit(0)))
    rows = with_totals(post.withColumn("score", score), [group], total=F.sum("score"), n=F.count(F.lit(1)))
    share = F.when(c("total") == 0, 1 / c("n")).otherwise(F.try_divide("score", "total"))
    return rows.withColumn("allocation_score", share).drop("total", "n", "score")


def budget_rule(df: DataFrame) -> DataFrame:
    """Action, budget, confidence and reason from ROAS, trend and allocation score."""
    roas, budget, s = c("roas"), c("current_budget"), c("allocation_score")
    text = F.format_string
    low, high = roas < LOW_BELOW, roas > HIGH_ABOVE
    better = c("trend") == "improving"
    case = (F.when(roas < PAUSE_BELOW, "pause").when(low & better, "low_keep").when(low, "low_cut").when(high, "high")
            .when(s > 0.3, "mid_up").when(s < 0.1, "mid_down").otherwise("mid_keep"))
    df = df.withColumn("__case", case)
    k = c("__case")
    out = df.withColumns({
        "action": F.when(k == "pause", "pause").when(k.isin("low_keep", "mid_keep"), "maintain").when(k.isin("low_cut", "mid_down"), "decrease").otherwise("increase"),
        "__new": F.when(k == "pause", 0.0).when(k == "low_cut", budget * 0.7).when(k == "high", budget * F.least(s * 0.5 + 1.3, F.lit(2.0)))
        .when(k == "mid_up", budget * (s * 0.3 + 1)).when(k == "mid_down", budget * 0.9).otherwise(budget),
        "__conf": F.when(k == "pause", 0.95).when(k == "low_keep", 0.7).when(k == "low_cut", 0.85).when(k == "high", 0.9).otherwise(0.75),
        "reasoning": F.when(k == "pause", text("ROAS (%s) below pause threshold (0.5)", fixed(roas, 2))).when(k == "low_keep", "ROAS low but improving trend detected")
        .when(k == "low_cut", text("ROAS (%s) below minimum threshold with %s trend", fixed(roas, 2), c("trend")))
        .when(k == "high", text("High performer (ROAS %s), allocation score %s", fixed(roas, 2), fixed(s, 2)))
        .when(k == "mid_up", text("Above average allocation score (%s)", fixed(s, 2))).when(k == "mid_down", text("Below average allocation score (%s)", fixed(s, 2)))
        .otherwise("Performance within expected range")})
    return out.withColumns({
        "recommended_budget": F.round("__new", 2), "change_pct": F.round(_change(c("__new"), budget), 1), "predicted_roas": c("roas_24h"),
        "confidence": F.round(c("__conf") * c("forecast_confidence"), 2)}).drop("__case", "__new", "__conf")


def _change(new: Column, old: Column) -> Column:
    return F.when(old > 0, F.try_divide(new - old, old) * 100).otherwise(0.0)


def constrain(recs: DataFrame, group: str, total: Column) -> DataFrame:
    """Scale recommendations to the total; skipped when it is missing, zero or already met."""
    rows = with_totals(recs, [group], __rec=F.sum("recommended_budget"), __cur=F.sum("current_budget")).withColumn("__total", total)
    scale = F.coalesce((c("__total") != 0) & (c("__total") != c("__cur")) & (c("__rec") != 0), F.lit(False))
    new = F.round(c("recommended_budget") * F.try_divide(c("__total"), c("__rec")), 2)
    rows = rows.withColumn("__new", F.when(scale, new).otherwise(c("recommended_budget")))
    return rows.withColumns({
        "change_pct": F.when(scale, F.round(_change(c("__new"), c("current_budget")), 1)).otherwise(c("change_pct")),
        "recommended_budget": c("__new")}).drop("__rec", "__cur", "__total", "__new")


def expected_improvement(recs: DataFrame, group: str) -> DataFrame:
    """Budget-weighted improvement in percent per group."""
    gain = (F.when(c("action") == "increase", c("recommended_budget") * 0.15).when(c("action") == "decrease", c("recommended_budget") * 0.05)
            .when(c("action") == "pause", c("current_budget") * 0.20).otherwise(0.0))
    g = recs.groupBy(group).agg(F.sum(gain).alias("gain"), F.sum("recommended_budget").alias("new"))
    return g.select(group, F.when(c("new") == 0, 0.0).otherwise(F.try_divide("gain", "new") * 100).alias("expected_improvement"))


def posterior_by_roas(observations: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Success per observation with ROAS above the threshold, and the exploration score."""
    win = F.count_if(c("roas") > threshold)
    g = observations.groupBy("campaign_id").agg(win.alias("wins"), F.count("roas").alias("n"))
    return g.select("campaign_id", (c("wins") + 1.0).alias("alpha"), (c("n") - c("wins") + 1.0).alias("beta"), "n",
                    F.when(c("n") == 0, 1.0).otherwise(1 / F.sqrt(F.greatest(c("n"), F.lit(1)))).alias("exploration"))


def thompson_shares(post: DataFrame, group: str, draws: int = DRAWS, run: int = 0) -> DataFrame:
    """Share of joint draws each campaign wins in its group.

    Every (campaign, draw) is a row with a draw of its own; the winner of a draw is
    a max_by with map-side combine, so a group of any size shares the work.
    """
    rows = post.select(group, "campaign_id", "alpha", "beta", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    drawn = once(rows, {"p": beta_draw(c("alpha"), c("beta"), draw_key(F.lit(run), c("campaign_id"), c("draw")))})
    winners = drawn.groupBy(group, "draw").agg(F.max_by("campaign_id", F.struct(c("p"), -c("campaign_id"))).alias("campaign_id"))
    won = winners.groupBy(group, "campaign_id").agg((F.count(F.lit(1)) / draws).alias("share"))
    return post.join(won, [group, "campaign_id"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def thompson_allocate(shares: DataFrame, group: str, total: Column, min_budget: float = MIN_BUDGET) -> DataFrame:
    """Budgets by share with a floor, in campaign order; the last campaign takes the rest.

    The sequential clamp has a closed form: what is free above the floors shrinks by each
    earlier campaign's wish, so a running sum replaces the loop.
    """
    rows = with_totals(shares.select(group, "campaign_id", "share", total.alias("total")), [group], n=F.count(F.lit(1)))
    rows = rows.withColumn("wish", F.greatest(F.lit(float(min_budget)), c("share") * c("total")) - min_budget)
    rows = ordered_scan(rows, [group], ["campaign_id"], F.floor(c("campaign_id") / 10000), before={"wished": c("wish")}, row_number="pos")
    slack = c("total") - c("n") * min_budget
    free = F.when(c("pos") == 1, slack).otherwise(F.greatest(F.lit(0.0), slack - c("wished")))
    short = F.when((slack < 0) & (c("pos") > 1), F.lit(0.0)).otherwise(free)
    extra = F.when(c("pos") == c("n"), short).otherwise(F.least(c("wish"), short))
    return rows.select(group, "campaign_id", "share", "total", (extra + min_budget).alias("allocated_budget"))


def budget_rule_v2(df: DataFrame) -> DataFrame:
    """Decision on the one-hour forecast."""
    p, roas, budget = c("roas_1h"), c("roas"), c("current_budget")
    pause, up = p < PAUSE_BELOW, (p > 3.0) & (roas > 2.0)
    text = F.format_string
    return df.withColumns({
        "action": F.when(pause, "pause").when(up, "increase").when(p < 1.0, "decrease").otherwise("maintain"),
        "recommended_budget": F.when(pause, 0.0).when(up, budget * 1.5).when(p < 1.0, F.greatest(budget * 0.75, F.lit(MIN_BUDGET))).otherwise(budget),
        "confidence": F.when(pause, 0.9).when(up, 0.85).when(p < 1.0, 0.75).otherwise(0.7),
        "reasoning": F.when(pause, text("Predicted ROAS (%s) below pause threshold (0.5)", fixed(p, 2)))
        .when(up, text("High ROAS (%s) with stable forecast. Scaling by 50%%", fixed(roas, 2)))
        .when(p < 1.0, "ROAS below 1.0. Reducing budget by 25%").otherwise("Performance within acceptable range")})


def action_log(recs: DataFrame, as_of: str, later: DataFrame | None = None) -> DataFrame:
    """Before / after rows of the changed campaigns; success once a later ROAS is known."""
    changed = recs.where(c("action") != "maintain").select(
        "campaign_id", c("action").alias("action_type"), F.lit(as_of).alias("executed_at"),
        F.to_json(F.struct(F.round("current_budget", 2).alias("budget"))).alias("before_state"),
        F.to_json(F.struct(F.round("recommended_budget", 2).alias("budget"))).alias("after_state"),
        c("reasoning").alias("reason"), "confidence", "roas")
    if later is None:
        return changed.withColumn("success", F.lit(None).cast("boolean")).drop("roas")
    out = changed.join(later.select("campaign_id", c("roas").alias("later_roas")), "campaign_id", "left")
    return out.withColumn("success", c("later_roas") > c("roas")).drop("roas", "later_roas")


def material_changes(recs: DataFrame, min_pct: float = 10.0) -> DataFrame:
    return recs.where(F.abs("change_pct") >= min_pct)


def bounded_change(current: Column, wanted: Column) -> Column:
    """At least the minimum budget, at most twice and at least half the current one; a pause stays 0."""
    inside = F.greatest(F.lit(MIN_BUDGET), current * MAX_DECREASE, F.least(wanted, current * MAX_INCREASE))
    return F.when(wanted == 0, 0.0).otherwise(inside)


FORECAST_INPUTS = ["roas", "ctr", "cvr", "cpc", "cpm", "cpa", "budget_util", "lag_1", "lag_2", "lag_3", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "spend"]


def forecaster_rows(metrics: DataFrame, budgets: DataFrame, horizon: int) -> DataFrame:
    """Fifteen inputs per campaign and step, and the ROAS ``horizon`` steps later."""
    series = Window.partitionBy("campaign_id").orderBy("day")  # one row per step
    rows = kpis(metrics).join(budgets.select("campaign_id", "budget"), "campaign_id")
    rows = temporal_features(rows.withColumn("at", c("day").cast("timestamp")), "at")
    rows = rows.withColumn("budget_util", F.try_divide("spend", "budget"))
    rows = rows.withColumns({f"lag_{i}": F.lag("roas", i).over(series) for i in (1, 2, 3)})
    return rows.withColumn("target", F.lead("roas", horizon).over(series)).na.drop(subset=["lag_3", "target"])


def train_forecaster(rows: DataFrame, split_day: str, trees: int = 20, seed: int = 42):
    """Boosted trees fitted on the days before split_day; returns (model, later rows scored)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    past = c("day") < F.lit(split_day).cast("date")
    steps = [VectorAssembler(inputCols=FORECAST_INPUTS, outputCol="inputs"),
             GBTRegressor(featuresCol="inputs", labelCol="target", maxIter=trees, maxDepth=4, seed=seed)]
    model = Pipeline(stages=steps).fit(rows.where(past))
    return model, model.transform(rows.where(~past))
