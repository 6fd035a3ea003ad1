"""Client health scores, churn probability and risk factors: pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.expr import clamp, first_of, fixed, nz, once
from spendlens.operators.monitoring import out_of_fold

c = F.col

# Weights, levels, texts.
WEIGHTS_V1 = {"roas_score": 0.30, "engagement_score": 0.25, "payment_score": 0.15, "communication_score": 0.15, "growth_score": 0.15}
WEIGHTS_V2 = {"roas_score": 0.25, "engagement_score": 0.20, "payment_score": 0.15, "communication_score": 0.20, "growth_score": 0.20}
ADVICE = {
    "ROAS Below Target": ["Schedule strategy review meeting to discuss campaign optimization",
                          "Analyze top-performing campaigns and reallocate budget"],
    "Low Platform Engagement": ["Send personalized check-in email with recent wins/opportunities",
                                "Share new platform features or industry insights"],
    "Support Escalations": ["Escalate to account manager for priority resolution",
                            "Schedule call to address concerns and rebuild trust"],
    "Payment Delays": ["Reach out to discuss payment flexibility options",
                       "Review contract terms and consider adjustments"],
    "Contract Ending Soon": ["Initiate renewal conversation with value proposition",
                             "Prepare ROI summary and future strategy deck"],
    "High Campaign Pause Rate": ["Analyze why campaigns were paused and propose reactivation",
                                 "Suggest new campaign strategies or creative refreshes"],
    "Lack of Communication": ["Schedule immediate check-in call",
                              "Send monthly performance report with insights"],
}
SURVIVAL_DAYS = [30, 60, 90, 120, 180]
HAZARD = 0.005
SCORE_BANDS = {"critical": 30, "warning": 50, "monitor": 70}


def _weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + c(name) * w
    return out


def health_score(df: DataFrame) -> DataFrame:
    """Five component scores and their weighted total, first scoring family."""
    total = F.greatest(c("campaigns_active") + c("campaigns_paused"), F.lit(1))
    parts = {
        "roas_score": clamp(c("actual_roas") / F.greatest(c("target_roas"), F.lit(0.1)) * 50 + c("roas_trend") * 20, 0, 100),
        "engagement_score": (F.greatest(F.lit(0.0), 100 - c("days_since_login") * 5.0) + F.greatest(F.lit(0.0), 100 - c("days_since_contact") * 3.0)) / 2,
        "payment_score": 100 - F.least(F.lit(100.0), c("payment_delays") * 25.0),
        "communication_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("meetings_30d") * 25.0) - F.least(F.lit(50.0), c("support_tickets_30d") * 10.0) + 25),
        "growth_score": F.least(F.lit(100.0), c("campaigns_active") / total * 50 + (c("avg_ctr") / 0.02 + c("avg_cvr") / 0.01) * 25),
    }
    scored = once(df, parts).withColumn("overall_score", _weighted(WEIGHTS_V1))
    return once(scored, {n: F.round(n, 1) for n in [*parts, "overall_score"]})


def _factor(when: Column, name: str, severity: Column, impact: float, text: Column, trend: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("factor"), severity.alias("severity"), F.lit(impact).alias("impact"),
                                 text.alias("description"), trend.alias("trend")))


def _by_impact(factors: Column) -> Column:
    """Descending impact, rule order among equals."""
    numbered = F.transform(factors, lambda x, i: F.struct((-x["impact"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(numbered), lambda y: y["x"])


def risk_factors(df: DataFrame) -> DataFrame:
    """Seven rules, each giving (factor, severity, impact, description, trend)."""
    level = lambda high: F.when(high, "high").otherwise("medium")
    actual, target, trend = c("actual_roas"), c("target_roas"), c("roas_trend")
    campaigns = c("campaigns_active") + c("campaigns_paused")
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    rules = [
        _factor(actual < target * 0.8, "ROAS Below Target", level(actual < target * 0.5), 0.25,
                text("Current ROAS (%s) is %s%% below target", fixed(actual, 2), fixed((1 - F.try_divide(actual, target)) * 100, 0)),
                F.when(trend < 0, "declining").when(trend > 0, "improving").otherwise("stable")),
        _factor(c("days_since_login") > 14, "Low Platform Engagement", level(c("days_since_login") > 30), 0.20,
                text("No login for %d days", c("days_since_login")), F.lit("declining")),
        _factor(c("support_tickets_30d") > 3, "Support Escalations", level(c("support_tickets_30d") > 5), 0.15,
                text("%d support tickets in last 30 days", c("support_tickets_30d")), F.lit("stable")),
        _factor(c("payment_delays") > 0, "Payment Delays",
                F.when(c("payment_delays") > 2, "high").when(c("payment_delays") > 1, "medium").otherwise("low"), 0.15,
                text("%d payment delay(s) recorded", c("payment_delays")), F.lit("stable")),
        _factor((c("contract_months_remaining") < 3) & ~c("is_on_annual"), "Contract Ending Soon", level(c("contract_months_remaining") < 1), 0.10,
                text("Contract ends in %d months", c("contract_months_remaining")), F.lit("stable")),
        _factor(F.try_divide(c("campaigns_paused"), campaigns) > 0.5, "High Campaign Pause Rate", F.lit("medium"), 0.10,
                text("%d/%d campaigns paused", c("campaigns_paused"), campaigns), F.lit("stable")),
        _factor((c("days_since_contact") > 21) & (c("meetings_30d") == 0), "Lack of Communication", F.lit("medium"), 0.10,
                text("No contact for %d days, 0 meetings this month", c("days_since_contact")), F.lit("declining")),
    ]
    return once(df, {"risk_factors": _by_impact(first_of(*rules))})


def churn(scored: DataFrame, as_of: str) -> DataFrame:
    """Churn probability, level, horizon and date from the score and the risk factors."""
    impact = F.aggregate(F.transform("risk_factors", lambda f: f["impact"]), F.lit(0.0), lambda a, b: a + b)
    adjusted = impact * F.when(c("is_on_annual"), 0.7).otherwise(1.0) * F.when(c("actual_roas") > c("target_roas") * 1.2, 0.6).otherwise(1.0)
    p = clamp(F.greatest(F.lit(0.0), (100 - c("overall_score")) / 100) * 0.6 + adjusted * 0.4, 0.05, 0.95)
    out = once(scored, {"__p": p})
    p = c("__p")
    out = out.withColumns({
        "churn_probability": F.round(p, 3),
        "risk_level": F.when(p >= 0.75, "critical").when(p >= 0.5, "warning").when(p >= 0.25, "monitor").otherwise("healthy"),
        "days_to_churn": F.when(p >= 0.75, 30).when(p >= 0.5, 60).when(p >= 0.25, 90)})
    return out.withColumn("predicted_churn_date", F.date_add(F.lit(as_of).cast("date"), c("days_to_churn"))).drop("__p")


def recommendations(df: DataFrame) -> DataFrame:
    """Two texts for each of the three strongest factors, distinct, at most five."""
    items: list[Column] = []
    for name, texts in ADVICE.items():
        items += [F.lit(name), F.array(*[F.lit(x) for x in texts])]
    advice = F.create_map(*items)
    texts = F.flatten(F.transform(F.slice("risk_factors", 1, 3), lambda f: F.element_at(advice, f["factor"])))
    return once(df, {"recommendations": F.slice(F.array_distinct(texts), 1, 5)})


def score_clients(metrics: DataFrame, as_of: str) -> DataFrame:
    return recommendations(churn(risk_factors(health_score(metrics)), as_of))


def health_score_v2(df: DataFrame) -> DataFrame:
    """Scores of the second family; ROAS, engagement and the total truncate toward zero."""
    whole = lambda x: x.cast("int")
    parts = {
        "roas_score": F.when(c("target_roas") > 0, F.least(F.lit(100), whole(F.try_divide(c("current_roas"), c("target_roas")) * 100))).otherwise(50),
        "engagement_score": whole(F.least(F.lit(100), c("logins_30d") * 5) * 0.6 + whole(c("meeting_rate") * 100) * 0.4),
        "payment_score": F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), c("payment_delay_days") * 10)),
        "communication_score": F.greatest(F.lit(0.0), 100 - F.least(F.lit(100.0), c("response_hours") * 2) - F.least(F.lit(50.0), c("last_contact_days") * 2.0)),
        "growth_score": clamp(c("revenue_mom_change") * 200 + 50, 0, 100),
    }
    return once(df, parts).withColumn("overall_score", whole(_weighted(WEIGHTS_V2)))


def churn_features(df: DataFrame) -> DataFrame:
    """Ten model inputs."""
    l30 = c("logins_30d") / 30
    return once(df, {
        "f_roas_ratio": F.when(c("target_roas") > 0, F.try_divide(c("current_roas"), c("target_roas"))).otherwise(1.0),
        "f_roas_trend": c("roas_trend"), "f_login": l30, "f_login_change": c("logins_7d") / 7 - l30,
        "f_response": 1 / (1 + c("response_hours") / 24), "f_payment": 1 / (1 + c("payment_delay_days") / 30),
        "f_mom": c("revenue_mom_change"), "f_tenure": F.log1p(c("tenure_months").cast("double")),
        "f_contract": nz("contract_days_remaining", 365) / 365,
        "f_sentiment": F.when(c("tickets_30d") > 0, c("ticket_sentiment")).otherwise(0.5)})


FEATURES = ["f_roas_ratio", "f_roas_trend", "f_login", "f_login_change", "f_response", "f_payment", "f_mom", "f_tenure", "f_contract", "f_sentiment"]


def _mean_feature() -> Column:
    total = F.lit(0.0)
    for f in FEATURES:
        total = total + c(f)
    return total / len(FEATURES)


def churn_v2(df: DataFrame, as_of: str) -> DataFrame:
    """Two score formulas, their mean, the level and the survival-based churn date."""
    boosted = ((1 - F.least(F.lit(1.0), c("f_roas_ratio"))) * 0.3 + (1 - F.least(F.lit(1.0), c("f_login") * 5)) * 0.2
               + (1 - c("f_response")) * 0.15 + (1 - c("f_payment")) * 0.15 + F.greatest(F.lit(0.0), -c("f_mom")) * 0.2)
    out = once(df, {"p_boosted": clamp(boosted, 0.05, 0.95), "p_mean": clamp(_mean_feature() * 0.5, 0.05, 0.95)})
    out = out.withColumn("churn_probability", (c("p_boosted") + c("p_mean")) / 2)
    p = c("churn_probability")
    out = survival(out.withColumns({
        "risk_level": F.when(p >= 0.7, "critical").when(p >= 0.5, "warning").when(p >= 0.3, "monitor").otherwise("healthy"),
        "confidence": F.lit(0.85)}))
    return out.withColumn("predicted_churn_date", F.date_add(F.lit(as_of).cast("date"), c("median_survival_days")))


def survival(df: DataFrame) -> DataFrame:
    """Exponential survival curve and the first 30-day step below one half, NULL if none."""
    rate = (_mean_feature() + 1) * HAZARD
    s = lambda t: F.exp(-rate * t)
    curve = F.array(*[F.struct(F.lit(t).alias("days"), s(F.lit(float(t))).alias("p")) for t in SURVIVAL_DAYS])
    steps = F.filter(F.sequence(F.lit(30), F.lit(360), F.lit(30)), lambda t: s(t.cast("double")) < 0.5)
    return once(df, {"survival_curve": curve, "median_survival_days": F.get(steps, F.lit(0))})


def risk_factors_v2(df: DataFrame) -> DataFrame:
    """Five rules over the second family's scores."""
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    rules = [
        _factor(c("roas_score") < 70, "Below Target ROAS", F.when(c("roas_score") < 50, "high").otherwise("medium"), 0.25,
                text("ROAS at %sx vs target %sx", fixed(c("current_roas"), 2), fixed(c("target_roas"), 2)), F.when(c("roas_trend") < 0, "declining").otherwise("stable")),
        _factor(c("engagement_score") < 60, "Low Engagement", F.lit("medium"), 0.20,
                text("Only %d dashboard logins in 30 days", c("logins_30d")), F.lit("declining")),
        _factor(c("communication_score") < 60, "Communication Gap", F.lit("medium"), 0.20,
                text("Average response time: %s hours", fixed(c("response_hours"), 0)), F.lit("declining")),
        _factor(c("payment_score") < 80, "Payment Delays", F.lit("medium"), 0.15,
                text("Average payment delay: %s days", fixed(c("payment_delay_days"), 0)), F.lit("stable")),
        _factor(c("revenue_mom_change") < -0.1, "Revenue Decline", F.lit("high"), 0.20,
                text("Revenue down %s%% month-over-month", fixed(F.abs("revenue_mom_change") * 100, 0)), F.lit("declining")),
    ]
    return once(df, {"risk_factors": _by_impact(first_of(*rules))})


def score_clients_v2(features: DataFrame, as_of: str) -> DataFrame:
    return risk_factors_v2(churn_v2(churn_features(health_score_v2(features)), as_of))


def snapshot(scored: DataFrame, as_of: str) -> DataFrame:
    """Daily health row per client, key (client_id, snapshot_date)."""
    return scored.select("client_id", F.lit(as_of).cast("date").alias("snapshot_date"), c("overall_score").cast("int").alias("overall_score"),
                         "roas_score", "engagement_score", "payment_score", "communication_score", "growth_score",
                         "churn_probability", "days_to_churn", F.to_json("risk_factors").alias("risk_factors"))


def alert_rows(scored: DataFrame, levels: tuple[str, ...] = ("critical", "warning")) -> DataFrame:
    return scored.where(c("risk_level").isin(*levels)).select("client_id", c("risk_level").alias("alert_type"), "churn_probability", "overall_score")


def score_band(score: Column) -> Column:
    out = F.when(score < SCORE_BANDS["critical"], "critical")
    return out.when(score < SCORE_BANDS["warning"], "warning").when(score < SCORE_BANDS["monitor"], "monitor").otherwise("healthy")


CHURN_INPUTS = ["actual_roas", "roas_trend", "days_since_login", "days_since_contact", "support_tickets_30d", "meetings_30d",
                "campaigns_active", "campaigns_paused", "payment_delays"]


def train_churn(metrics: DataFrame, label: Column, seed: int = 42):
    """Random forest on the client metrics; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = metrics.withColumn("label", label.cast("double"))
    steps = [VectorAssembler(inputCols=CHURN_INPUTS, outputCol="inputs"), RandomForestClassifier(featuresCol="inputs", numTrees=20, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def churn_scores(metrics: DataFrame, label: Column, key: str = "client_id", folds: int = 2) -> DataFrame:
    """Every client with its label and the score of a model that did not see it."""
    from pyspark.ml.functions import vector_to_array

    def fit(rows: DataFrame):
        model = train_churn(rows, F.col("label"))
        return lambda others: model.transform(others).withColumn("score", vector_to_array("probability")[1]).select(key, "fold", "label", "score")

    return out_of_fold(metrics.withColumn("label", label.cast("double")), key, fit, folds)
