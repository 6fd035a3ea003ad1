"""Prediction error, drift, A/B analysis and retraining decisions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.expr import hash_bucket
from spendlens.operators.joins import predictions_with_actuals
from spendlens.operators.timeseries import drift
from spendlens.session import staged

c = F.col

# Significance and degradation limits.
Z_LIMIT, RMSE_LIMIT = 1.96, 0.5


def error_metrics(predictions: DataFrame, actuals: DataFrame, order: str = "seq") -> DataFrame:
    """MAE, MSE, RMSE and sample size per model; a model without matches has no row."""
    d = c("prediction") - c("actual")
    j = predictions_with_actuals(predictions, actuals, order)
    g = j.groupBy("model").agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.count(F.lit(1)).alias("samples"))
    return g.withColumn("rmse", F.sqrt("mse"))


def any_drift(predictions: DataFrame) -> DataFrame:
    return drift(predictions).agg(F.coalesce(F.max("drift_detected"), F.lit(False)).alias("any_drift"), F.count_if("drift_detected").alias("models_drifted"))


def assign_variant(user: Column, test: Column, split: float, running: Column | None = None) -> Column:
    """Sticky variant from a hash of test and user; a test that is not running gives control."""
    share = hash_bucket(F.concat_ws(":", test, user.cast("string")), 10000) / 10000
    treated = share < split
    return F.when(treated if running is None else treated & running, "treatment").otherwise("control")


def ab_analysis(outcomes: DataFrame, method: str = "pooled") -> DataFrame:
    """Means, lift, z score and winner per test; one aggregate over both arms.

    method="pooled" divides by the pooled population deviation, "welch" by the standard error.
    """
    arm = lambda v: F.when(c("variant") == v, c("value"))
    g = outcomes.groupBy("test_id").agg(
        F.avg(arm("control")).alias("control_mean"), F.avg(arm("treatment")).alias("treatment_mean"),
        F.count(arm("control")).alias("control_samples"), F.count(arm("treatment")).alias("treatment_samples"),
        F.var_pop(arm("control")).alias("vc"), F.var_pop(arm("treatment")).alias("vt"))
    enough = (c("control_samples") > 0) & (c("treatment_samples") > 0)
    delta = c("treatment_mean") - c("control_mean")
    if method == "welch":
        spread = F.sqrt(F.try_divide("vc", "control_samples") + F.try_divide("vt", "treatment_samples"))
    else:
        spread = F.sqrt((c("vc") + c("vt")) / 2)
    g = g.withColumns({"lift": F.when(enough, delta / (c("control_mean") + 1e-6)), "z_score": F.when(enough, F.abs(delta) / (spread + 1e-6))})
    g = g.withColumn("significant", c("z_score") > Z_LIMIT)
    winner = F.when(c("significant") & (c("lift") > 0), "treatment").when(c("significant") & (c("lift") < 0), "control").otherwise("inconclusive")
    return g.select("test_id", "control_mean", "treatment_mean", "lift", (c("lift") * 100).alias("lift_percent"), "z_score", "significant",
                    "control_samples", "treatment_samples", F.when(enough, winner).alias("winner"), F.when(~enough, "Insufficient data").alias("error"))


def should_retrain(models: DataFrame, drifted: DataFrame, errors: DataFrame, schedule: DataFrame, as_of: str) -> DataFrame:
    """Reason per model in priority order: drift, overdue schedule, high error, none."""
    j = models.select("model").join(drifted.select("model", "drift_detected"), "model", "left").join(
        errors.select("model", "rmse"), "model", "left").join(schedule.select("model", "interval_days", "last_retrain"), "model", "left")
    overdue = F.datediff(F.lit(as_of).cast("date"), c("last_retrain")) > c("interval_days")
    no = lambda x: F.coalesce(x, F.lit(False))
    reason = F.when(no(c("drift_detected")), "drift_detected").when(no(overdue), "scheduled").when(
        no(c("rmse") > RMSE_LIMIT), "performance_degradation").otherwise("no_action_needed")
    return j.select("model", reason.alias("reason"), (reason != "no_action_needed").alias("retrain"))


def out_of_fold(rows: DataFrame, key: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: int = 2) -> DataFrame:
    """Every row scored by a model that was fitted on the other folds; a key's fold is a hash of it, the same on any engine.

    ``fit`` takes rows and returns what scores rows.  Adds fold.
    """
    rows = staged(rows.withColumn("fold", hash_bucket(F.concat(F.lit("fold:"), F.col(key).cast("string")), folds)), "folds")
    parts = [fit(rows.where(F.col("fold") != k))(rows.where(F.col("fold") == k)) for k in range(folds)]
    return staged(reduce(DataFrame.unionByName, parts), "scored")


def calibration(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """(bin, rows, mean_score, share): how often the label is 1 where the score says so."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return scored.groupBy(at).agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share"))


def beats_constant(scored: DataFrame, score: str = "score", label: str = "label", of: float = 1.0) -> DataFrame:
    """(rows, better): whether the squared error of out-of-fold scores is below ``of`` times that of the other folds' mean label."""
    by = scored.groupBy("fold").agg(F.sum(label).alias("s"), F.count(F.lit(1)).alias("n"))
    all_s, all_n = scored.agg(F.sum(label)).scalar(), scored.agg(F.count(F.lit(1))).scalar()
    constant = by.select("fold", ((all_s - F.col("s")) / (all_n - F.col("n"))).alias("constant"))
    wrong = scored.join(constant, "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("model"),
        F.sum(F.pow(F.col("constant") - F.col(label), F.lit(2))).alias("naive"))
    return wrong.select("rows", (F.col("model") < F.col("naive") * of).alias("better"))
