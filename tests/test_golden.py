"""Known inputs with independently computed outputs."""

import datetime as dt
import hashlib
import hmac
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spendlens.operators import aggregates, alerts, attribution, audience, budget, creative, health, monitoring, normalize, quality, timeseries
from spendlens.streaming import stateful, webhooks, windows

PATHS = [
    (1, ["meta_ads", "google_ads", "email"], True, 150.0), (2, ["organic", "meta_ads", "email"], True, 125.0),
    (3, ["google_ads", "meta_ads"], True, 200.0), (4, ["meta_ads"], True, 100.0), (5, ["organic", "google_ads"], False, 0.0)]


@pytest.fixture(scope="module")
def journeys(spark):
    rows, t0 = [], dt.datetime(2024, 1, 1)
    for user, channels, converted, value in PATHS:
        for i, ch in enumerate(channels):
            last = converted and i == len(channels) - 1
            rows.append((0, user, user * 10 + i, t0 + dt.timedelta(hours=5 * i), ch, 1, 0.0, last, value if last else 0.0))
    ev = spark.createDataFrame(rows, "client_id long, user_id long, event_id long, ts timestamp_ntz, channel string, campaign_id long, cost double, is_conversion boolean, value double")
    return attribution.build_journeys(ev)


def shares(df, name):
    return {r["channel"]: round(r[name], 4) for r in df.collect()}


def test_attribution_sample(journeys):
    pc = attribution.path_channels(journeys)
    assert shares(attribution.shapley_value(pc), "shapley") == {"meta_ads": 0.5072, "google_ads": 0.2609, "email": 0.1594, "organic": 0.0725}
    assert shares(attribution.first_touch(pc), "first_touch") == {"meta_ads": 0.4348, "google_ads": 0.3478, "organic": 0.2174}
    assert shares(attribution.last_touch(pc), "last_touch") == {"meta_ads": 0.5217, "email": 0.4783}
    markov = attribution.markov_removal(attribution.transition_edges(journeys))
    assert shares(markov, "markov") == {"meta_ads": 0.6521, "email": 0.3479, "google_ads": 0.0, "organic": 0.0}
    assert markov.first()["base_rate"] == pytest.approx(0.799421, abs=1e-6)
    totals = attribution.report_totals(attribution.paths(journeys)).first()
    assert (totals["conversions"], totals["total_value"], totals["avg_touchpoints"]) == (4, 575.0, pytest.approx(2.2))


def test_attribution_invariants(journeys):
    pc = attribution.path_channels(journeys)
    edges = attribution.transition_edges(journeys)
    rows = edges.groupBy("from_state").agg(F.sum("p").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1.0) for r in rows)
    for df, name in ((attribution.shapley_rate(pc), "shapley_rate"), (attribution.markov_greedy(edges), "markov_greedy"), (attribution.linear(pc), "linear"),
                     (attribution.time_decay(journeys), "time_decay"), (attribution.position_based(journeys, attribution.paths(journeys)), "position_based")):
        assert df.agg(F.sum(name)).first()[0] == pytest.approx(1.0), name


def _counted(spark, n, rows):
    return spark.createDataFrame([(1, n, *r) for r in rows], "client_id long, n_channels long, mask long, journeys long, conversions long")


def test_coalitions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(m, j, rng.randint(0, j)) for m in [*range(1, 60, 3), *(1 << k for k in range(8))] if (j := rng.randint(1, 9))]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["s"]: (r["journeys"], r["conversions"]) for r in attribution.coalition_values(_counted(spark, 8, rows)).collect()}
    want = {s: (sum(j for m, j, _ in rows if m & s), sum(c for m, _, c in rows if m & s)) for s in range(1, 256)}
    assert got == want


def test_twenty_channels_share_by_rate(spark):
    """Channels that always occur alone, all at one rate, earn the same; the rate of a silent one is smaller."""
    n = 20
    masks = _counted(spark, n, [(1 << k, 10, 0 if k == 7 else 5) for k in range(n)])
    pc = spark.createDataFrame([(1, k, f"c{k:02}") for k in range(n)], "client_id long, path_id long, channel string")
    got = {r["channel"]: r["shapley_rate"] for r in attribution.shapley_rate(pc, attribution.coalition_values(masks)).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert len({round(v, 9) for c, v in got.items() if c != "c07"}) == 1 and got["c07"] < got["c00"]


CLIENTS = [
    ("Acme", 25000.0, 4.0, 3.2, -0.2, 12, 8, 2, 1, 5, 2, 0.022, 0.015, 4, False, 0),
    ("TechStart", 15000.0, 5.0, 5.8, 0.3, 2, 3, 0, 2, 8, 0, 0.028, 0.018, 10, True, 0),
    ("RetailMax", 45000.0, 4.5, 4.2, -0.05, 5, 15, 3, 0, 12, 3, 0.019, 0.012, 2, False, 1)]
COLUMNS = ("client_id string, monthly_spend double, target_roas double, actual_roas double, roas_trend double, days_since_login int, days_since_contact int, "
           "support_tickets_30d int, meetings_30d int, campaigns_active int, campaigns_paused int, avg_ctr double, avg_cvr double, contract_months_remaining int, "
           "is_on_annual boolean, payment_delays int")


def test_client_health_samples(spark):
    got = {r["client_id"]: r for r in health.score_clients(spark.createDataFrame(CLIENTS, COLUMNS), "2024-01-01").collect()}
    a = got["Acme"]
    assert [a[c] for c in ("overall_score", "roas_score", "engagement_score", "payment_score", "communication_score", "growth_score")] == [59.8, 36.0, 58.0, 100.0, 30.0, 100.0]
    assert (a["churn_probability"], a["risk_level"], a["days_to_churn"]) == (0.241, "healthy", None)
    assert (got["TechStart"]["overall_score"], got["TechStart"]["churn_probability"]) == (83.1, 0.101)
    r = got["RetailMax"]
    assert (r["overall_score"], r["churn_probability"], r["risk_level"], r["days_to_churn"]) == (55.3, 0.368, "monitor", 90)
    assert [f["factor"] for f in r["risk_factors"]] == ["Payment Delays", "Contract Ending Soon"]
    assert r["predicted_churn_date"] == dt.date(2024, 3, 31)


@pytest.mark.parametrize("series,want", [
    ([10.5, 11.2, 11.8, 12.1, 11.5, 11.74], (11.74, 11.69, 11.46, 0.95)),
    ([4.5, 4.2, 4.0, 3.8, 3.9, 3.98], (3.98, 4.00, 4.07, 0.94)),
    ([12.0, 12.5, 13.0, 13.2, 13.5, 13.64], (13.64, 13.51, 12.98, 0.95))])
def test_forecast_samples(spark, series, want):
    rows = spark.createDataFrame([(1, len(series) - i, v) for i, v in enumerate(series)], "campaign_id long, rn int, roas double")
    now = spark.createDataFrame([(1, series[-1])], "campaign_id long, roas double")
    r = timeseries.forecast(timeseries.series_stats(rows), now).first()
    assert r["trend"] == "stable"
    assert (r["roas_1h"], r["roas_6h"], r["roas_24h"], r["forecast_confidence"]) == want


def test_forecast_short_history(spark):
    rows = spark.createDataFrame([(1, 1, 2.0)], "campaign_id long, rn int, roas double")
    now = spark.createDataFrame([(1, 2.0), (2, 3.0)], "campaign_id long, roas double")
    got = {r["campaign_id"]: r for r in timeseries.forecast(timeseries.series_stats(rows), now).collect()}
    assert got[1]["roas_1h"] == pytest.approx(1.96) and got[2]["roas_24h"] == pytest.approx(2.7) and got[2]["forecast_confidence"] == 0.3


def test_metric_series_sample(spark):
    names = ["spend", "revenue", "clicks", "impressions", "conversions"]
    cols = [[100, 150, 120, 180, 200, 160, 140], [500, 750, 600, 900, 1000, 800, 700], [50, 75, 60, 90, 100, 80, 70],
            [2000, 3000, 2400, 3600, 4000, 3200, 2800], [5, 8, 6, 9, 10, 8, 7]]
    rows = [(1, dt.date(2024, 1, 1 + i), *[float(c[i]) for c in cols]) for i in range(7)]
    df = spark.createDataFrame(rows, "campaign_id long, day date, " + ", ".join(f"{n} double" for n in names))
    t = aggregates.campaign_totals(df).first()
    assert (t["roas"], t["cpc"], t["cpm"], round(t["cpa"], 4)) == (5.0, 2.0, pytest.approx(50.0), 19.8113)
    s = timeseries.campaign_series_features(df).first()
    assert (s["roas_total"], s["roas_trend_7d"], round(s["spend_volatility"], 4)) == (5.0, pytest.approx(0.0), 31.6228)


def test_normalisation_falsy_values(spark):
    rows = [("", "id1", "n", "ACTIVE", 5000.0, 0.0), ("c2", "id2", "n", "PAUSED", None, 20000.0)]
    df = spark.createDataFrame(rows, "campaign_id string, id string, name string, status string, daily_budget double, lifetime_budget double").withColumns(
        {"objective": F.lit("o"), "start_time": F.lit("s"), "stop_time": F.lit("e")})
    a, b = normalize.normalize_campaigns(df, "meta").orderBy("external_id").collect()[::-1]
    assert (a["external_id"], a["daily_budget"], a["lifetime_budget"], a["status"]) == ("id1", 50.0, None, "active")
    assert (b["external_id"], b["daily_budget"], b["lifetime_budget"]) == ("c2", 0.0, 200.0)


def test_quality_samples(spark):
    ids = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 1, 3, 2])], "seq long, id long")
    assert sorted(r["seq"] for r in quality.dedupe(ids, ["id"], ["seq"]).collect()) == [0, 1, 3]
    metrics = spark.createDataFrame([(1.0, 2, 3), (0.0, 0, 0), (5.0, None, 1), (-1.0, 1, 1)], "spend double, clicks long, impressions long")
    assert quality.validation_summary(metrics, quality.rules_for("metrics")).first().asDict() == {
        "total_records": 4, "valid_records": 2, "invalid_records": 2, "valid": False}


def test_archetype_order_shadows_three_names(spark):
    grid = spark.range(21).select((F.col("id") / 5 + 1).alias("r"))
    grid = grid.join(grid.select(F.col("r").alias("f"))).join(grid.select(F.col("r").alias("m")))
    names = {r[0] for r in grid.select(audience.archetype(F.col("r"), F.col("f"), F.col("m"))).distinct().collect()}
    assert names.isdisjoint({"At Risk", "Can't Lose", "Lost"}) and "Champions" in names


def test_lookalike_sample(spark):
    seed = spark.createDataFrame([(1000 + i, 400.0 + 10 * i, 10.0) for i in range(10)], "user_id long, ltv double, frequency double")
    pool = spark.createDataFrame([(i, 100.0 + 20 * i, float(i % 12)) for i in range(100)], "user_id long, ltv double, frequency double")
    out = audience.lookalike_threshold(seed, pool, 20, 2.0, ["ltv", "frequency"]).collect()
    assert len(out) <= 20 and all(r["similarity"] >= 0.4 for r in out)
    assert audience.lookalike_topn(seed, pool, 2.0, ["ltv", "frequency"]).count() == 20


def test_creative_sample(spark):
    row = ("c", "50% Off Everything - Today Only!", "Shop now and save big on our entire collection. Limited time offer.", "SHOP_NOW", "meta", "retail")
    df = spark.createDataFrame([row], "creative_id string, headline string, body string, cta string, platform string, industry string")
    r = creative.predict(df).first()
    assert r["headline_words"] == 6 and r["has_numbers"] and r["urgency"] == pytest.approx(0.8) and r["power_urgency"] == pytest.approx(0.75)
    modifier = 1.15 * 1.12 * (1 + 0.8 * 0.15) * (1 + 0.75 * 0.05) * (1 + 0.25 * 0.05) * (0.8 + 0.75 * 0.4)
    assert r["predicted_ctr"] == pytest.approx(0.022 * modifier, abs=1e-4)
    assert r["confidence"] == 0.85


def ctx(spark, **over):
    base = dict(client_id="x", client_name="X", health_score=50.0, churn_probability=0.1, roas=5.0, target_roas=4.0, monthly_spend=5000.0,
                last_contact_days=1, engagement_score=80.0, contract_end_days=None)
    base.update(over)
    schema = ("client_id string, client_name string, health_score double, churn_probability double, roas double, target_roas double, monthly_spend double, "
              "last_contact_days int, engagement_score double, contract_end_days int")
    return spark.createDataFrame([tuple(base.values())], schema)


def test_interventions_rank_and_dedupe(spark):
    got = alerts.interventions(ctx(spark, churn_probability=0.8, monthly_spend=25000.0, roas=1.0, engagement_score=20.0, last_contact_days=40, health_score=20.0)).collect()
    assert [r["position"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["type"] for r in got] == ["training", "reactivation", "discount", "outreach", "escalation"]
    assert [round(r["rank_score"], 3) for r in got] == [22.84, 20.95, 18.4, 18.36, 16.715]
    assert all(a["rank_score"] >= b["rank_score"] for a, b in zip(got, got[1:]))
    assert alerts.interventions(ctx(spark, contract_end_days=0)).count() == 0
    assert alerts.interventions(ctx(spark, contract_end_days=10)).first()["due_days"] == 3


def test_alert_sample(spark):
    df = spark.createDataFrame([("Acme", 0.88, None)], "client_name string, churn_probability double, risk_factors string")
    rows = alerts.render(alerts.evaluate_rules(df)).collect()
    assert [r["rule_id"] for r in rows] == ["churn_critical"]
    assert rows[0]["title"] == "Critical Churn Risk" and '"client_name":"Acme"' in rows[0]["message"]


def test_drift_sample(spark):
    rows = [("m", i, 0.10 + 0.15 * (i / 100) if i < 100 else 0.22 + 0.16 * ((i - 100) / 100), i) for i in range(200)]
    df = spark.createDataFrame(rows, "model string, id long, prediction double, ts long")
    r = timeseries.drift(df).first()
    assert r["drift_detected"] and r["n"] == 200
    assert timeseries.drift(df.where("id < 99")).count() == 0


def test_allocation_totals(spark):
    post = spark.createDataFrame([(1, i, 1.0 + i, 10.0) for i in range(8)], "account_id long, campaign_id long, alpha double, beta double")
    rows = budget.thompson_allocate(budget.thompson_shares(post, "account_id", draws=200), "account_id", F.lit(500.0)).orderBy("campaign_id").collect()
    assert sum(r["allocated_budget"] for r in rows) == pytest.approx(500.0)
    # the sequential clamp, spelled out
    left, want = 500.0, []
    for i, r in enumerate(rows[:-1]):
        b = min(max(10.0, r["share"] * 500.0), left - 10.0 * (len(rows) - i - 1))
        want.append(b)
        left -= b
    assert [r["allocated_budget"] for r in rows] == pytest.approx(want + [left])


def test_ab_needs_both_arms(spark):
    df = spark.createDataFrame([("t", "control", 1.0)], "test_id string, variant string, value double")
    assert monitoring.ab_analysis(df).first()["error"] == "Insufficient data"


def test_hmac_matches_the_standard_library(spark):
    got = spark.createDataFrame([('{"a": 1}',)], "payload string").select(webhooks.hmac_sha256("secret", F.col("payload"))).first()[0]
    assert got == hmac.new(b"secret", b'{"a": 1}', hashlib.sha256).hexdigest()


@pytest.mark.parametrize("ordered", [True, False])
def test_alert_stream_equals_batch(spark, tmp_path, ordered):
    rows = [("r", 1 + i % 3, i, 1_700_000_000 + (i * 211) % 90000) for i in range(400)]
    rows.sort(key=lambda r: r[3] if ordered else (r[2] * 37) % 400)
    schema = "rule_id string, user_id long, event_id long, s long"
    end = [("r", u, -u, 1_700_900_000) for u in (1, 2, 3)]
    make = lambda part: spark.createDataFrame(part, schema).select("rule_id", "user_id", "event_id", F.timestamp_seconds("s").alias("ts"), F.lit(60).alias("cooldown_minutes"))
    landing = str(tmp_path / "in")
    for part in (rows[:150], rows[150:300], rows[300:], end):
        make(part).coalesce(1).write.mode("append").parquet(landing)
    late = "1 hour" if ordered else "48 hours"
    stream = spark.readStream.schema(make(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(landing)
    windows.run_append(stateful.alert_stream(stream, ["rule_id", "user_id"], late), str(tmp_path / "out"), str(tmp_path / "ckpt"), stateful.STORE)
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).where("event_id >= 0").collect())
    want = sorted(r["event_id"] for r in alerts.cooldown(make(rows), ["rule_id", "user_id"], tie="event_id").collect())
    assert got == want


def test_changes_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped after every file: waiting rows, timers and the last checksum are those of the checkpoint."""
    rows = [(1 + i % 2, "abc"[(i * i // 3) % 3], i, 1_700_000_000 + (i * 97) % 5000) for i in range(120)]
    make = lambda part: spark.createDataFrame(part, "id long, v string, event_id long, s long").select("id", "v", "event_id", F.timestamp_seconds("s").alias("ts"))
    landing, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for part in (rows[:50], rows[50:], [(k, "z", -k, 1_700_900_000) for k in (1, 2)], [(k, "z", -9, 1_700_000_001) for k in (1, 2)]):
        make(part).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(make(rows[:1]).schema).parquet(landing)
        windows.run_append(stateful.changes_stream(stream, "id", ["v"], "48 hours"), out, ckpt, stateful.STORE)
    got = sorted((r["id"], r["event_id"]) for r in spark.read.parquet(out).collect() if r["event_id"] >= 0)
    want, last = [], {}
    for k, v, e, _ in sorted(rows, key=lambda r: (r[3], r[2])):
        if last.get(k) != v:
            want.append((k, e))
        last[k] = v
    assert got == sorted(want)


class StateCalls:
    """Value, map state and timers of one key held in memory; every call is counted."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def __getattr__(self, name):
        return {"getValueState": lambda *_: StateOfCalls(self), "getMapState": lambda *_: StateOfCalls(self),
                "registerTimer": lambda t: self.count(self.timers.add(t)), "deleteTimer": lambda t: self.count(self.timers.discard(t))}[name]

    def count(self, result=None):
        self.calls += 1
        return result


class StateOfCalls:
    def __init__(self, of):
        self.of, self.rows = of, {}

    get = lambda self: self.of.count(self.rows.get(()))
    update = lambda self, v: self.of.count(self.rows.update({(): v}))
    clear = lambda self: self.of.count(self.rows.clear())
    containsKey = lambda self, k: self.of.count(k in self.rows)
    getValue = lambda self, k: self.of.count(self.rows[k])
    updateValue = lambda self, k, v: self.of.count(self.rows.update({k: v}))
    removeKey = lambda self, k: self.of.count(self.rows.pop(k))


def test_keyed_state_is_touched_by_the_piece(spark):
    """Thousands of slices of one key in three blocks of mixed order, released in two steps."""
    handle, n = StateCalls(), 6000
    keyed = stateful.InOrder("us: long, event_id: long, checksum: string", "string", stateful._changes, ["id"], ["event_id"])
    keyed.init(handle)
    rows = [{"id": 1, "us": (i * 1511 % n) * 3_000_000, "event_id": i, "checksum": "abc"[i * i // 3 % 3]} for i in range(n)]
    for part in (rows[:2500], rows[2500:5990], rows[5990:]):
        assert list(keyed.handleInputRows((1,), iter(part), None)) == []
    got = []
    for mark in (n // 2 * 3000 + 1, 2**41):
        wait = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        for t in sorted(t for t in handle.timers if t <= mark):
            for out in keyed.handleExpiredTimer((1,), wait, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)):
                got += out["event_id"]
            handle.timers.discard(t)
        assert all(rows[i]["us"] // 1_000_000 * 1000 < mark for i in got)
    want, last = [], None
    for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
        if r["checksum"] != last:
            want.append(r["event_id"])
        last = r["checksum"]
    assert got == want and not handle.timers
    assert handle.calls < 100


def test_a_key_of_few_rows_costs_few_state_calls():
    """Three rows of a key, taken in twice and released: one read and one write of the state each time, and the timers."""
    handle = StateCalls()
    keyed = stateful.InOrder("us: long, event_id: long, checksum: string", "string", stateful._changes, ["id"], ["event_id"])
    keyed.init(handle)
    rows = [{"id": 1, "us": us, "event_id": i, "checksum": v} for i, (us, v) in enumerate([(9_000_000, "a"), (5_000_000, "b"), (7_000_000, "b")])]
    for part in (rows[:1], rows[1:]):
        assert list(keyed.handleInputRows((1,), iter(part), None)) == []
    got = []
    for mark in (8000, 2**41):
        wait = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        for t in [t for t in handle.timers if t <= mark]:
            got += [x for out in keyed.handleExpiredTimer((1,), wait, None) for x in out["event_id"]]
            handle.timers.discard(t)
    assert got == [1, 0] and not handle.timers
    calls = handle.calls
    assert calls <= 13, calls
    # a row like the last one, after all others have gone, is no change
    assert list(keyed.handleInputRows((1,), iter([{"id": 1, "us": 9_500_000_000_000, "event_id": 9, "checksum": "a"}]), None)) == []
    assert list(keyed.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2**62), None)) == []
