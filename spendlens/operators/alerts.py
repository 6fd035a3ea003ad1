"""Alert rules, cooldown, messages, state and interventions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.expr import epoch_us, first_of, fixed, nz, once
from spendlens.functions.skew import first_per_key, join_back, ordered_scan, with_totals
from spendlens.session import staged

c = F.col


@dataclass(frozen=True)
class AlertRule:
    """A named condition over the context columns."""

    rule_id: str
    name: str
    alert_type: str
    severity: str
    condition: Column
    cooldown_minutes: int
    enabled: bool = True


def default_rules() -> dict[str, AlertRule]:
    """The five built-in rules."""
    p = nz("churn_probability", 0.0)
    rules = [
        AlertRule("churn_critical", "Critical Churn Risk", "churn_risk", "critical", p >= 0.8, 240),
        AlertRule("churn_high", "High Churn Risk", "churn_risk", "high", (p >= 0.6) & (p < 0.8), 1440),
        AlertRule("roas_drop", "ROAS Drop Alert", "roas_drop", "high", nz("roas_change", 0.0) < -0.3, 60),
        AlertRule("budget_depleted", "Budget Depleted", "budget_depleted", "medium", nz("budget_remaining_percent", 100.0) < 10, 60),
        AlertRule("model_drift", "Model Drift Detected", "model_drift", "high", nz("drift_score", 0.0) > 0.15, 1440),
    ]
    return {r.rule_id: r for r in rules}


def toggled(rules: dict[str, AlertRule], rule_id: str, enabled: bool) -> dict[str, AlertRule]:
    return {**rules, rule_id: replace(rules[rule_id], enabled=enabled)}


def evaluate_rules(ctx: DataFrame, rules: dict[str, AlertRule] | None = None, alert_type: str | None = None) -> DataFrame:
    """One row per context row and triggered rule; missing context columns take their defaults."""
    for name in ("churn_probability", "roas_change", "budget_remaining_percent", "drift_score"):
        if name not in ctx.columns:
            ctx = ctx.withColumn(name, F.lit(None).cast("double"))
    rules = default_rules() if rules is None else rules
    used = [r for r in rules.values() if r.enabled and (alert_type is None or r.alert_type == alert_type)]
    hits = first_of(*[F.when(r.condition, F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.alert_type).alias("alert_type"),
        F.lit(r.severity).alias("severity"), F.lit(r.cooldown_minutes).alias("cooldown_minutes"))) for r in used])
    return ctx.select("*", F.inline(hits))


# ---- cooldown ------------------------------------------------------------------------------
#
# A trigger fires when the last fired one is at least the cooldown away, so the outcome depends
# on the whole history of its key.  A gap of a full cooldown always restarts the chain: runs
# between such gaps are independent, and a run shorter than the cooldown fires only its first
# row.  Other runs of few rows are folded as an array.  In long ones each instant points to its
# successor, the first instant a cooldown later, found by an as-of scan in time buckets; what the
# run's first instant leads to is marked by pointer doubling, in as many rounds as the chain's length has digits.

BUCKET_US = 60_000_000  # a window holds one key's instants within a minute
FOLD_ROWS = 1024  # runs up to this many instants are folded in one row


def cooldown(triggers: DataFrame, keys: list[str], tie: str, at: str = "ts", minutes: str = "cooldown_minutes",
             bucket_us: int = BUCKET_US, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Triggers that fire; of several at one instant the first by ``tie``.

    keys = ["rule_id"] is the original scope (one client's alert mutes the others); add an
    entity column for independent cooldowns per entity.  The cooldown is the same for all triggers of a key.
    """
    us = epoch_us(at)
    cool = c(minutes).cast("bigint") * 60_000_000
    instants = triggers.select(*keys, us.alias("us"), cool.alias("cool")).distinct()
    bucket = F.floor(c("us") / F.lit(bucket_us))
    gaps = ordered_scan(instants, keys, ["us"], bucket, lag={"prev_us": c("us")})
    gaps = gaps.withColumn("opens", (c("prev_us").isNull() | (c("us") - c("prev_us") >= c("cool"))).cast("bigint")).drop("prev_us")
    runs = ordered_scan(gaps, keys, ["us"], bucket, before={"earlier": c("opens")}).withColumn("run", c("earlier") + c("opens")).drop("earlier")
    run_keys = [*keys, "run"]
    runs = staged(with_totals(runs, run_keys, run_end=F.max("us"), run_start=F.min("us"), run_rows=F.count(F.lit(1))), "runs")
    many = (c("run_end") - c("run_start") >= c("cool")) & (c("run_rows") > fold_rows)
    few = (c("run_end") - c("run_start") >= c("cool")) & (c("run_rows") <= fold_rows)
    heads = runs.where(~few & ~many & (c("opens") == 1)).select(*keys, "us")

    short = runs.where(few).groupBy(*run_keys).agg(F.array_sort(F.collect_list("us")).alias("all_us"), F.max("cool").alias("cool"))
    start = F.struct(F.lit(-(2**62)).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("fired"))
    fold = F.aggregate("all_us", start, lambda acc, x: F.when(
        x - acc["last"] >= c("cool"), F.struct(x.alias("last"), F.array_append(acc["fired"], x).alias("fired"))).otherwise(acc), lambda acc: acc["fired"])
    folded = short.select(*keys, F.explode(fold).alias("us"))
    longest = runs.where(many).agg(F.max(F.floor((c("run_end") - c("run_start")) / c("cool")))).first()[0]
    fired = heads.unionByName(folded)
    if longest:
        steps = _successors(runs.where(many), run_keys, bucket_us)
        marked = _led_to(runs.where(many & (c("opens") == 1)).select(*run_keys, "us"), steps, run_keys, int(longest))
        fired = fired.unionByName(marked.select(*keys, "us"))
    return first_per_key(join_back(triggers.withColumn("us", us), fired, [*keys, "us"]), [*keys, "us"], [tie]).drop("us")


def _successors(rows: DataFrame, keys: list[str], bucket_us: int) -> DataFrame:
    """(keys, us, nxt): of every instant the first one of its key at least ``cool`` later; none, no row.

    Instants and the moments asked for are put in one order per key and bucket, walked from the latest back; a bucket
    hands the least instant after it to the ones before.
    """
    none = F.lit(None).cast("bigint")
    told = rows.select(*keys, c("us").alias("moment"), c("us").alias("instant"), none.alias("us"))
    asked = rows.select(*keys, (c("us") + c("cool")).alias("moment"), none.alias("instant"), "us")
    both = told.unionByName(asked).withColumn("bucket", F.floor(c("moment") / F.lit(bucket_us)))
    back = Window.partitionBy(*keys, "bucket").orderBy(F.desc("moment")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(*keys, "bucket").agg(F.min("instant").alias("least")).select(*keys, "bucket", F.min("least").over(across).alias("later"))
    found = join_back(both.withColumn("within", F.min("instant").over(back)), carry, [*keys, "bucket"])
    return found.where("us is not null").select(*keys, "us", F.coalesce("within", "later").alias("nxt")).where("nxt is not null")


def _led_to(heads: DataFrame, steps: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys, us): the heads (keys, us) and all that at most ``longest`` of the steps (keys, us, nxt) lead to from them.

    Steps of 1, 2, 4, ... are written one after the other; then, from the longest down, each marked instant marks where
    the step of that length leads, so that every count of steps is taken once.
    """
    tables = [staged(steps, "steps")]
    for _ in range(max(0, longest.bit_length() - 1)):
        first = tables[-1].withColumnsRenamed({"us": "first", "nxt": "us"})
        tables.append(staged(join_back(first, tables[-1], [*keys, "us"]).select(*keys, c("first").alias("us"), "nxt"), "steps"))
    reached = heads
    for table in reversed(tables):
        onward = join_back(reached, table, [*keys, "us"], "left")
        reached = onward.select(*keys, F.explode(F.array_compact(F.array("us", "nxt"))).alias("us"))
    return reached


# ---- messages and state --------------------------------------------------------------------

def render(alerts: DataFrame) -> DataFrame:
    """Title and message per alert type; a missing field gives the rule name and the context as JSON."""
    for name, kind in {"client_name": "string", "risk_factors": "string", "campaign_name": "string", "current_roas": "double", "model_name": "string"}.items():
        if name not in alerts.columns:
            alerts = alerts.withColumn(name, F.lit(None).cast(kind))
    kind = c("alert_type")
    need = {"churn_risk": ["client_name", "churn_probability", "risk_factors"], "roas_drop": ["campaign_name", "roas_change", "current_roas"],
            "budget_depleted": ["campaign_name", "budget_remaining_percent"], "model_drift": ["model_name", "drift_score"]}
    title = {"churn_risk": F.format_string("Churn Risk: %s", c("client_name")), "roas_drop": F.format_string("ROAS Drop: %s", c("campaign_name")),
             "budget_depleted": F.format_string("Budget Low: %s", c("campaign_name")), "model_drift": F.format_string("Model Drift: %s", c("model_name"))}
    text = {
        "churn_risk": F.format_string("Client %s has %s%% churn probability. Risk factors: %s", c("client_name"), fixed(c("churn_probability") * 100, 0), c("risk_factors")),
        "roas_drop": F.format_string("Campaign %s ROAS dropped by %s%%. Current: %sx", c("campaign_name"), fixed(c("roas_change") * 100, 0), fixed(c("current_roas"), 2)),
        "budget_depleted": F.format_string("Campaign %s has only %s%% budget remaining.", c("campaign_name"), fixed(c("budget_remaining_percent"), 0)),
        "model_drift": F.format_string("Model %s shows drift score of %s. Consider retraining.", c("model_name"), fixed(c("drift_score"), 2)),
    }
    context = F.to_json(F.struct(*[c(f) for fields in need.values() for f in fields if f in alerts.columns]))
    whole = {k: (kind == k) & _all_present(f) for k, f in need.items()}
    pick = lambda options, default: F.coalesce(*[F.when(whole[k], v) for k, v in options.items()], default)
    return alerts.withColumns({"title": pick(title, c("rule_name")), "message": pick(text, context)})


def _all_present(fields: list[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & c(f).isNotNull()
    return out


def alert_state(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with the latest acknowledge and resolve of their action log."""
    when = lambda a, x: F.max_by(F.when(c("action") == a, x), F.when(c("action") == a, c("at")))
    s = actions.groupBy("alert_id").agg(when("acknowledge", c("at")).alias("acknowledged_at"), when("acknowledge", c("user")).alias("acknowledged_by"),
                                        when("resolve", c("at")).alias("resolved_at"))
    return alerts.join(s, "alert_id", "left")


def dashboard_alerts(scored: DataFrame, state: DataFrame, limit: int = 5) -> DataFrame:
    """At-risk clients first, then campaigns above ROAS 10; the first few."""
    risk = scored.where(c("risk_level").isin("critical", "warning")).select(
        F.lit(0).alias("part"), c("client_id").alias("id"), F.lit("warning").alias("type"),
        F.format_string('Client "%s" health score dropped to %d', c("client_name"), c("overall_score").cast("int")).alias("message"),
        F.format_string("%d days to potential churn", F.coalesce(c("days_to_churn"), F.lit(30))).alias("time"))
    won = state.where(c("roas") > 10).select(
        F.lit(1).alias("part"), c("campaign_id").alias("id"), F.lit("success").alias("type"),
        F.format_string('Campaign "%s" ROAS increased to %sx', c("campaign_name"), fixed(c("roas"), 1)).alias("message"), F.lit("Real-time").alias("time"))
    return risk.unionByName(won).orderBy("part", "id").limit(limit)


# ---- interventions -------------------------------------------------------------------------

# Template -> (type, title, description, action items, expected impacts, due days).
TEMPLATES = {
    "executive_outreach": ("outreach", "Executive Business Review", "Schedule executive-level call to discuss account strategy and value.",
                           ["Review account history and prepare insights", "Prepare ROI analysis deck", "Schedule call with C-level stakeholder",
                            "Present value proposition and roadmap"],
                           {"health_score": 15.0, "churn_probability": -0.20}, 3),
    "performance_optimization": ("optimization", "Campaign Optimization Session", "Deep-dive optimization to improve underperforming campaigns.",
                                 ["Analyze top 5 underperforming campaigns", "Identify creative and targeting issues", "Implement optimizations",
                                  "Set up enhanced monitoring"],
                                 {"roas": 0.5, "health_score": 10.0}, 5),
    "retention_discount": ("discount", "Loyalty Discount Offer", "Offer strategic discount to retain high-value client.",
                           ["Calculate client lifetime value", "Determine discount tier (10-25%)", "Prepare contract amendment",
                            "Present offer with value framing"],
                           {"churn_probability": -0.30, "health_score": 20.0}, 7),
    "training_session": ("training", "Platform Training & Best Practices", "Comprehensive training to improve client's platform utilization.",
                         ["Assess current platform usage", "Identify feature adoption gaps", "Create customized training plan",
                          "Deliver training and provide resources"],
                         {"engagement_score": 25.0, "health_score": 8.0}, 14),
    "manager_escalation": ("escalation", "Account Manager Escalation", "Escalate to senior account manager for strategic review.",
                           ["Document all account issues", "Brief senior AM on situation", "Schedule joint client call", "Develop recovery action plan"],
                           {"health_score": 12.0, "churn_probability": -0.15}, 2),
    "quick_win_campaign": ("optimization", "Quick Win Campaign Setup", "Launch proven high-ROAS campaign to demonstrate value.",
                           ["Identify best performing templates", "Create campaign with proven targeting", "Set conservative initial budget",
                            "Monitor closely for first 7 days"],
                           {"roas": 1.0, "health_score": 15.0}, 7),
    "reactivation_campaign": ("reactivation", "Client Reactivation Campaign", "Multi-touch reactivation for dormant client.",
                              ["Research recent company news/changes", "Prepare personalized reactivation offer", "Execute 5-touch outreach sequence",
                               "Track and follow up on engagement"],
                              {"health_score": 30.0}, 21),
}
PRIORITY = {"immediate": 4, "high": 3, "medium": 2, "low": 1}
EFFORT_HOURS = {"immediate": 4, "high": 3, "medium": 2, "low": 2}
KEEP = 5


def channel(kind: str) -> Column:
    """Contact channel for an intervention type."""
    personal = "meeting" if kind in ("outreach", "escalation") else "phone"
    default = "meeting" if kind == "training" else "email"
    return F.when(c("monthly_spend") > 20000, personal).when(c("churn_probability") > 0.7, "phone").otherwise(default)


def _candidate(when: Column, template: str, priority: str, confidence: float) -> Column:
    kind, title, text, items, impact, due = TEMPLATES[template]
    rank = PRIORITY[priority] * 2 + sum(abs(v) for v in impact.values()) * 0.5 + confidence * 3
    pairs = [x for k, v in impact.items() for x in (F.lit(k), F.lit(v))]
    return F.when(when, F.struct(
        F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit(priority).alias("priority"), channel(kind).alias("channel"),
        F.lit(text).alias("description"), F.array(*[F.lit(i) for i in items]).alias("action_items"), F.create_map(*pairs).alias("impact"),
        F.lit(confidence).alias("confidence"), F.lit(due).alias("due_days"), F.lit(rank).alias("rank_score")))


def intervention_candidates() -> Column:
    """Candidate interventions in rule order."""
    p, spend, roas, target = c("churn_probability"), c("monthly_spend"), c("roas"), c("target_roas")
    contact, health, end = c("last_contact_days"), c("health_score"), c("contract_end_days")
    critical = p >= 0.7
    rules = first_of(
        _candidate(critical, "executive_outreach", "immediate", 0.92), _candidate(critical, "manager_escalation", "immediate", 0.88),
        _candidate(critical & (spend > 10000), "retention_discount", "high", 0.75),
        _candidate(~critical & (p >= 0.5), "executive_outreach", "high", 0.85),
        _candidate(roas < target * 0.8, "performance_optimization", "high", 0.90),
        _candidate((roas < target * 0.8) & (roas < target * 0.5), "quick_win_campaign", "high", 0.82),
        _candidate(c("engagement_score") < 40, "training_session", "medium", 0.78),
        _candidate((contact > 14) & (health < 60), "executive_outreach", "medium", 0.72),
        _candidate(F.coalesce((end != 0) & (end < 30), F.lit(False)), "executive_outreach", "high", 0.88),
        _candidate((contact > 30) & (health < 30), "reactivation_campaign", "medium", 0.65))
    return rules


def interventions(ctx: DataFrame) -> DataFrame:
    """One row per client and recommended intervention with its position.

    The first candidate of a (type, title) stays and the five best by rank score are kept, all
    inside the row: no shuffle, however many clients there are.
    """
    staged = once(ctx, {"__c": intervention_candidates()})
    seen = F.transform("__c", lambda x: F.concat_ws("|", x["type"], x["title"]))
    staged = once(staged, {"__u": F.filter("__c", lambda x, i: F.array_position(seen, F.concat_ws("|", x["type"], x["title"])) == i + 1)})
    order = F.array_sort(F.transform("__u", lambda x, i: F.struct((-x["rank_score"]).alias("k"), i.alias("i"))))
    best = F.transform(F.slice(order, 1, KEEP), lambda o: F.element_at(c("__u"), o["i"].cast("int") + 1))
    return staged.withColumn("__best", best).select(*ctx.columns, F.posexplode("__best").alias("position", "__x")).select(
        *ctx.columns, (c("position") + 1).alias("position"), "__x.*")


def intervention_impact(recommended: DataFrame) -> DataFrame:
    """Combined effect of a client's interventions: health up to 100, churn down to 0, effort in hours."""
    effect = lambda k: F.coalesce(F.try_element_at("impact", F.lit(k)), F.lit(0.0))
    hours = F.coalesce(*[F.when(c("priority") == p, h) for p, h in EFFORT_HOURS.items()])
    g = recommended.groupBy("client_id").agg(
        F.max("health_score").alias("current_health_score"), F.max("churn_probability").alias("current_churn_probability"), F.max("roas").alias("current_roas"),
        F.sum(effect("health_score")).alias("dh"), F.sum(effect("churn_probability")).alias("dp"), F.sum(effect("roas")).alias("dr"),
        F.count(F.lit(1)).alias("interventions_count"), F.sum(hours).alias("estimated_effort_hours"))
    return g.select("client_id", "current_health_score", F.least(F.lit(100.0), c("current_health_score") + c("dh")).alias("predicted_health_score"),
                    "current_churn_probability", F.greatest(F.lit(0.0), c("current_churn_probability") + c("dp")).alias("predicted_churn_probability"),
                    "current_roas", (c("current_roas") + c("dr")).alias("predicted_roas"), "interventions_count", "estimated_effort_hours")


def effectiveness(tracked: DataFrame, kind: str | None = None) -> DataFrame:
    """Completed interventions: sample size, success rate, average whole days."""
    rows = tracked.where("status = 'completed'")
    if kind:
        rows = rows.where(c("type") == kind)
    ok = nz("churn_prevented", False) | nz("health_improved", False)
    days = F.floor((epoch_us("completed_at") - epoch_us("created_at")) / 86400e6)
    return rows.agg(F.count(F.lit(1)).alias("sample_size"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("success_rate"),
                    F.coalesce(F.avg(days), F.lit(0.0)).alias("avg_completion_days"))
