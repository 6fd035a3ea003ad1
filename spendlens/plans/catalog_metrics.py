"""Registered queries: listings, joins, aggregates and time series."""

from pyspark.sql import functions as F

from spendlens.operators import aggregates as A
from spendlens.operators import attribution as T
from spendlens.operators import creative as R
from spendlens.operators import joins as J
from spendlens.operators import listing as L
from spendlens.operators import timeseries as W
from spendlens.operators.normalize import kpis
from spendlens.plans.catalog_attribution import share_sql
from spendlens.plans.catalog_ingest import KPI, KPI_COLS, MEMBERS, metric_rows, segment_members
from spendlens.plans.registry import query
from spendlens.plans.views import AS_OF_EVENTS, AS_OF_ORDERS, rnd

# ---- listings ------------------------------------------------------------------------------

PAGE = """select *, count(*) over () as total, row_number() over (order by {k}) as row_no from ({q}) qualify row_no between {a} and {b}"""


@query("f01_list_campaigns", "campaigns", PAGE.format(k="campaign_id", a=11, b=20, q="select campaign_id, campaign_name, platform, status from campaigns where platform = 'meta' and status = 'active'"))
def _(t):
    return L.list_campaigns(t.campaigns, platform="meta", status="active", page_no=2, size=10).select(
        "campaign_id", "campaign_name", "platform", "status", "row_no", "total")


@query("f02_list_clients_search", "clients", PAGE.format(k="client_id", a=1, b=500, q="select client_id, client_name, industry from clients where is_active and industry = 'BUILDING' and lower(client_name) like '%00000%'"))
def _(t):
    return L.list_clients(t.clients, is_active=True, industry="BUILDING", search="00000", size=500).select("client_id", "client_name", "industry", "row_no", "total")


GRAMS = "list_distinct(list_transform(range(1, length('  ' || {x} || ' ')::bigint - 1), lambda i: substr('  ' || {x} || ' ', i, 3)))"


@query("f03_creative_search_trigram", "creatives", f"""
select creative_id, similarity from (select creative_id, len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::double as similarity from (
  select creative_id, {GRAMS.format(x='lower(headline)')} as g, {GRAMS.format(x="'the reader and then'")} as q from creatives)) where similarity >= 0.1""", r="similarity")
def _(t):
    return L.creative_search(t.creatives, "the reader and then", 0.1).select("creative_id", "similarity")


@query("f04_client_health_filter", "scored", "select client_id, risk_level, overall_score from scored where risk_level = 'warning' and overall_score between 20 and 45")
def _(t):
    return L.client_health(t.scored, "warning", 20, 45).select("client_id", "risk_level", "overall_score")


@query("f05_churn_alerts", "alerts", "select alert_id, alert_type, created_at from alerts where status = 'open' and alert_type = 'churn_risk' order by created_at desc, alert_id limit 50")
def _(t):
    return L.churn_alerts(t.alerts, alert_type="churn_risk").select("alert_id", "alert_type", "created_at")


@query("f06_at_risk", "scored", f"""
select client_id, overall_score, churn_probability, datediff('day', date '{AS_OF_ORDERS}', contract_end) as days_to_renewal
from scored where overall_score < 50 order by churn_probability desc, client_id limit 20""")
def _(t):
    return L.at_risk(t.scored, AS_OF_ORDERS).select("client_id", "overall_score", "churn_probability", F.col("days_to_renewal").cast("bigint").alias("days_to_renewal"))


@query("f07_journeys", "paths journeys", """
select path_id, value, touchpoints from paths where converted and client_id = 2 and touchpoints >= 3
  and last_touch_at::date between date '2024-01-05' and date '2024-01-25' and path_id in (select path_id from journeys where channel = 'email') order by path_id limit 100""", r="value")
def _(t):
    return L.journeys(t.paths, t.journeys, 2, "2024-01-05", "2024-01-25", "email", 3).select("path_id", "value", "touchpoints")


@query("f08_segments_filter", "", f"select distinct segment, user_id from ({MEMBERS}) where segment = 'buyers'")
def _(t):
    return L.where_all(segment_members(t), segment="buyers", user_id=None)


@query("f09_optimization_history", "", """
select o_orderkey as action_id, o_custkey as campaign_id, o_orderdate::date as executed_at from orders where o_custkey = 899 order by o_orderdate desc, o_orderkey limit 10""")
def _(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("action_id"), F.col("o_custkey").alias("campaign_id"), F.col("o_orderdate").cast("date").alias("executed_at"))
    return L.newest(L.where_all(o, campaign_id=899), "executed_at", "action_id", 10)


@query("f10_active_alerts", "alerts", "select alert_id, severity, created_at from alerts where resolved_at is null and severity = 'high'")
def _(t):
    return L.active_alerts(t.alerts, severity="high").select("alert_id", "severity", "created_at")


@query("f10_resolved_alerts", "alerts", "select alert_id, severity, created_at from alerts where resolved_at is not null")
def _(t):
    return L.active_alerts(t.alerts, severity="high", resolved=True).select("alert_id", "severity", "created_at")


@query("f11_top_campaigns", "campaign_state", f"""
select campaign_id, campaign_name, {rnd('roas', 2)} as roas, {rnd('spend_today', 2)} as spend from campaign_state order by campaign_state.roas desc, campaign_id limit 4""")
def _(t):
    return L.top_campaigns(t.campaign_state)


@query("f12_soft_delete", "clients", "select client_id, is_active and client_id % 5 <> 0 as is_active from clients")
def _(t):
    return L.soft_delete(t.clients, t.clients.where("client_id % 5 = 0")).select("client_id", "is_active")


@query("f13_campaign_creatives", "ad_sets creatives", """
select creative_id, c.ad_set_id from creatives c join ad_sets s on c.ad_set_id = s.ad_set_id where s.campaign_id = 3""")
def _(t):
    return L.campaign_creatives(3, t.ad_sets, t.creatives).select("creative_id", "ad_set_id")


@query("f14_lookup", "clients", "select client_id, client_name from clients where client_id = 42")
def _(t):
    return L.lookup(t.clients, "client_id", 42).select("client_id", "client_name")


# ---- joins ---------------------------------------------------------------------------------

@query("j01_entity_chain", "campaigns ad_sets ads", """
select r_regionkey::bigint as client_id, account_id, campaign_id, s.ad_set_id, count(*) as ads from region join campaigns c on c.client_id = r_regionkey
join ad_sets s using (campaign_id) join ads a on a.ad_set_id = s.ad_set_id group by 1, 2, 3, 4""")
def _(t):
    clients = t.raw("region").select(F.col("r_regionkey").cast("bigint").alias("client_id"))
    accounts = t.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("account_id"), F.col("n_regionkey").cast("bigint").alias("client_id"))
    chain = J.entity_chain(clients, accounts, t.campaigns.select("campaign_id", "account_id"), t.ad_sets, t.ads)
    return chain.groupBy("client_id", "account_id", "campaign_id", "ad_set_id").agg(F.count(F.lit(1)).alias("ads"))


@query("j02_polymorphic_fact_join", "ad_metrics campaigns", """
select 'campaign' as entity_type, m.campaign_id as entity_id, campaign_name as entity_name, sum(clicks)::bigint as clicks from ad_metrics m join campaigns using (campaign_id) group by all
union all select 'account', account_id, n_name, sum(clicks)::bigint from ad_metrics m join campaigns using (campaign_id) join nation on n_nationkey = account_id group by all""")
def _(t):
    camp = metric_rows(t)
    by_account = t.ad_metrics.join(t.campaigns.select("campaign_id", "account_id"), "campaign_id").select(
        F.lit("account").alias("entity_type"), F.col("account_id").alias("entity_id"), "day", "impressions", "clicks", "conversions", "spend", "revenue")
    facts = camp.unionByName(by_account)
    out = J.polymorphic(facts, {"campaign": (t.campaigns, "campaign_id", "campaign_name"), "account": (t.accounts, "account_id", "name")})
    return out.groupBy("entity_type", "entity_id", "entity_name").agg(F.sum("clicks").alias("clicks"))


@query("j03_touch_campaign_left", "touchpoints campaigns", """
select event_id, campaign_id, campaign_name, platform from touchpoints left join (select * from campaigns where campaign_id % 2 = 0) using (campaign_id)""")
def _(t):
    return J.touch_campaign(t.touchpoints, t.campaigns.where("campaign_id % 2 = 0")).select("event_id", "campaign_id", "campaign_name", "platform")


MATCHED = """select p.model, p.id, p.prediction, a.actual from predictions p join (
  select * from actuals qualify row_number() over (partition by model, id order by seq desc) = 1) a on p.id = a.id"""


@query("j04_prediction_actual", "predictions actuals", MATCHED, r="prediction actual")
def _(t):
    return J.predictions_with_actuals(t.predictions, t.actuals).select("model", "id", "prediction", "actual")


@query("j05_latest_snapshot", "clients snapshots", """
select c.client_id, s.snapshot_date, s.health_score from clients c left join (
  select * from snapshots where snapshot_date <= date '1999-06-30' qualify row_number() over (partition by client_id order by snapshot_date desc) = 1) s
on s.client_id = c.client_id""")
def _(t):
    return J.latest_snapshot(t.clients, t.snapshots, "1999-06-30").select("client_id", "snapshot_date", "health_score")


@query("j05_as_of_join", "snapshots interactions", """
select interaction_id, i.client_id, s.health_score, s.snapshot_date as snapshot_date_used
from (select *, (occurred_at - interval 45 day)::date as day from interactions) i asof left join snapshots s on i.client_id = s.client_id and i.day >= s.snapshot_date""")
def _(t):
    left = t.interactions.select("interaction_id", "client_id", F.date_sub(F.col("occurred_at").cast("date"), 45).alias("day"))
    return J.as_of_join(left, t.snapshots, "client_id", "day", "snapshot_date", ["health_score"]).drop("day")


@query("j06_outcome_assignment", "ab_outcomes", """
select variant, count(*) as outcomes from ab_outcomes where user_id % 4 <> 0 group by 1""")
def _(t):
    assigned = t.ab_outcomes.where("user_id % 4 <> 0").select("test_id", "user_id", "variant").distinct()
    return J.outcomes_with_variant(t.ab_outcomes.drop("variant"), assigned).groupBy("variant").agg(F.count(F.lit(1)).alias("outcomes"))


def values_sql(d, k):
    return f"select * from (values {', '.join(f'({n!r}, {v['ctr']}::double, {v['cvr']}::double)' for n, v in d.items())}) v({k}, ctr, cvr)"


BENCH = f"""left join ({values_sql(R.INDUSTRY_BENCHMARKS, 'ind')}) bi on bi.ind = coalesce((select ind from ({values_sql(R.INDUSTRY_BENCHMARKS, 'ind')}) where ind = c.industry), 'default')
  left join ({values_sql(R.PLATFORM_MULTIPLIERS, 'plat')}) bp on bp.plat = c.platform"""


@query("j07_benchmark_lookup", "creatives", f"""
select creative_id, bi.ctr as base_ctr, bi.cvr as base_cvr, bp.ctr as ctr_mult, bp.cvr as cvr_mult from creatives c {BENCH}""")
def _(t):
    return J.with_benchmark(t.creatives, R.INDUSTRY_BENCHMARKS, R.PLATFORM_MULTIPLIERS).select("creative_id", "base_ctr", "base_cvr", "ctr_mult", "cvr_mult")


@query("j08_channel_full_outer", "path_channels", f"""
select client_id, channel, coalesce(first_touch, 0)::double as first_touch, coalesce(last_touch, 0)::double as last_touch
from ({share_sql('first_touch', 'value', "converted and opens and channel <> 'email'")})
full join ({share_sql('last_touch', 'value', "converted and closes and channel <> 'meta'")}) using (client_id, channel)""", r="first_touch last_touch")
def _(t):
    pc = t.path_channels
    return J.channel_full_outer(T.first_touch(pc.where("channel <> 'email'")), T.last_touch(pc.where("channel <> 'meta'")), ["client_id", "channel"])


@query("j09_coalition_masks", "path_channels", """
with bits as (select client_id, channel, row_number() over (partition by client_id order by channel) - 1 as bit from (select distinct client_id, channel from path_channels)),
  masks as (select client_id, mask, count(*) as n, count(*) filter (conv) as c from (
    select p.client_id, path_id, sum(1::bigint << bit::int)::bigint as mask, bool_or(converted) as conv
    from path_channels p join bits b on p.client_id = b.client_id and p.channel = b.channel group by 1, 2) group by 1, 2)
select client_id, s, sum(c)::bigint as conversions, sum(n)::bigint as journeys, sum(c) / sum(n)::double as v
from masks, range(1, 32) g(s) where mask & s <> 0 group by 1, 2""", r="v")
def _(t):
    return T.coalition_values(T.channel_masks(t.path_channels)).drop("n_channels")


@query("j10_neighbour_counts", "", """
with p as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select a.vec_id, count(*) as neighbours from p a join p b on list_distance(a.v, b.v) <= 1.2::double group by 1""")
def _(t):
    return J.vector_neighbour_counts(t.raw("embeddings"), "vec_id", "embedding", 1.2)


@query("j11_seed_exclusion", "user_profiles", "select user_id from user_profiles where purchases_30d < 15")
def _(t):
    return J.exclude_seed(t.user_profiles, t.user_profiles.where("purchases_30d >= 15")).select("user_id")


@query("j12_member_profiles", "user_profiles", f"select segment, user_id, sessions_30d from ({MEMBERS}) join user_profiles using (user_id)")
def _(t):
    return J.member_profiles(segment_members(t), t.user_profiles).select("segment", "user_id", "sessions_30d")


# ---- aggregates ----------------------------------------------------------------------------

SUMS = "sum(spend) as spend, sum(revenue) as revenue, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions, sum(conversions)::bigint as conversions"


@query("a01_campaign_totals", "ad_metrics", f"select *, {KPI} from (select campaign_id, {SUMS} from ad_metrics group by 1)", r=f"spend revenue {KPI_COLS}")
def _(t):
    return A.campaign_totals(t.ad_metrics)


for _g, _fmt in {"daily": "day", "weekly": "week"}.items():
    @query(f"a02_campaign_metrics_{_g}", "ad_metrics", f"""
select bucket, {SUMS}, coalesce(sum(revenue) / nullif(sum(spend), 0), 0) as roas from (
  select *, strftime(date_trunc('{_fmt}', day), '%Y-%m-%d 00:00') as bucket from ad_metrics where campaign_id = 5 and day between date '1998-01-01' and date '1999-06-30')
group by rollup(bucket)""", r="spend revenue roas")
    def _(t, g=_g):
        return A.campaign_metrics(t.ad_metrics, 5, "1998-01-01", "1999-06-30", g)


@query("a02_campaign_metrics_hourly", "touchpoints", """
select bucket, sum(cost) as spend, sum(v) as revenue, sum(c)::bigint as clicks, count(*) as impressions, sum(c)::bigint as conversions,
  coalesce(sum(v) / nullif(sum(cost), 0), 0) as roas from (
  select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') as bucket, cost, case when is_conversion then value else 0 end as v, is_conversion::int as c
  from touchpoints where campaign_id = 5) group by rollup(bucket)""", r="spend revenue roas")
def _(t):
    rows = t.touchpoints.select("campaign_id", "ts", F.col("cost").alias("spend"), F.when(F.col("is_conversion"), F.col("value")).otherwise(0.0).alias("revenue"),
                                F.col("is_conversion").cast("bigint").alias("clicks"), F.lit(1).cast("bigint").alias("impressions"),
                                F.col("is_conversion").cast("bigint").alias("conversions"))
    return A.campaign_metrics(rows, 5, "2024-01-01", "2024-01-31", "hourly", at="ts")


@query("a03_dashboard_summary", "campaign_state campaigns scored", """
select (select case when sum(spend_today) > 0 then sum(revenue) / sum(spend_today) else 0 end from campaign_state) as total_roas,
  (select count(*) from campaigns where status = 'active') as active_campaigns, count(*) as total_clients,
  count(*) filter (risk_level in ('critical', 'warning')) as at_risk_clients from scored""", r="total_roas")
def _(t):
    return A.dashboard_summary(t.campaign_state, t.campaigns, t.scored)


ACTIVITY = """select user_id, sum(cost) as spend, sum(case when is_conversion then touchpoints.value else 0 end) as revenue, count(*) filter (event_type = 'click') as clicks,
  count(*) as impressions, count(*) filter (is_conversion) as conversions from touchpoints join events using (event_id, user_id) group by 1"""


def activity(t):
    return t.touch_events.select(
        "user_id", F.col("cost").alias("spend"), F.when(F.col("is_conversion"), F.col("value")).otherwise(0.0).alias("revenue"),
        (F.col("event_type") == "click").cast("bigint").alias("clicks"), F.lit(1).cast("bigint").alias("impressions"), F.col("is_conversion").cast("bigint").alias("conversions"))


@query("a04_segment_performance", "touchpoints", f"select *, {KPI} from (select segment, {SUMS} from ({MEMBERS}) join ({ACTIVITY}) using (user_id) group by 1)",
       r=f"spend revenue {KPI_COLS}", digits=3)
def _(t):
    return A.segment_performance(segment_members(t), activity(t))


def metrics_with_industry(t):
    m = t.ad_metrics.withColumn("clicks", F.col("clicks") % 37)
    return m.join(t.campaigns.select("campaign_id", "industry", "platform"), "campaign_id")


WITH_IND = "select m.* replace (clicks % 37 as clicks), industry, platform from ad_metrics m join campaigns using (campaign_id)"


@query("a05_benchmarks", "ad_metrics campaigns", f"""
select industry, platform, avg(ctr) as avg_ctr, avg(cvr) as avg_cvr, avg(cpm) as avg_cpm, avg(cpc) as avg_cpc, count(*) as sample_size,
  quantile_cont(ctr, 0.5) as median_ctr, quantile_cont(ctr, 0.9) as top10_ctr
from (select *, {KPI} from ({WITH_IND}) where day > date '2000-12-31' - 90 and day <= date '2000-12-31') group by 1, 2""",
       r="avg_ctr avg_cvr avg_cpm avg_cpc median_ctr top10_ctr", digits=5)
def _(t):
    return A.benchmarks(metrics_with_industry(t), "2000-12-31")


# exact quantiles, and that those of merged daily sketches stand within the stated rank error
@query("a05_benchmarks_approx", "ad_metrics campaigns", f"""
select industry, platform, count(*) as sample_size, quantile_cont(ctr, 0.5) as median_ctr, quantile_cont(ctr, 0.9) as top10_ctr, true as median_within, true as top10_within
from (select *, {KPI} from ({WITH_IND}) where day > date '2000-12-31' - 90 and day <= date '2000-12-31') group by 1, 2""", r="median_ctr top10_ctr", digits=5)
def _(t):
    return A.sketch_check(metrics_with_industry(t), "2000-12-31")


@query("a06_alert_stats", "alerts", """
select 'severity' as "group", severity as value, count(*) as alerts from alerts where resolved_at is null group by 2
union all select 'type', alert_type, count(*) from alerts where resolved_at is null group by 2
union all select 'total', 'all', count(*) from alerts where resolved_at is null""")
def _(t):
    return A.alert_stats(t.alerts)


@query("a10_creative_totals", "creatives", f"""
select creative_id, {SUMS} from (select p_partkey % 1000 as creative_id, l_extendedprice * 0.02 as spend, l_extendedprice * l_discount as revenue,
  l_quantity::bigint as clicks, l_quantity::bigint * 100 as impressions, 1 as conversions from lineitem join part on p_partkey = l_partkey) group by 1""", r="spend revenue", digits=2)
def _(t):
    q = F.col("l_quantity").cast("bigint")
    rows = t.raw("lineitem").join(t.raw("part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("p_partkey") % 1000).alias("creative_id"), (F.col("l_extendedprice") * 0.02).alias("spend"), (F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"),
        q.alias("clicks"), (q * 100).alias("impressions"), F.lit(1).cast("bigint").alias("conversions"))
    return A.creative_totals(rows)


def ad_level(t):
    q = F.col("l_quantity").cast("bigint")
    rows = t.raw("lineitem").select(F.col("l_suppkey").alias("campaign_id"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ad_set_id"),
                                    (F.col("l_extendedprice") * 0.02).alias("spend"), (F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"),
                                    q.alias("clicks"), (q * 100).alias("impressions"), F.lit(1).cast("bigint").alias("conversions"))
    return rows.join(t.campaigns.select("campaign_id", "account_id"), "campaign_id")


AD_LEVEL = """select account_id, campaign_id, l_suppkey * 10 + l_linenumber as ad_set_id, l_extendedprice * 0.02 as spend, l_extendedprice * l_discount as revenue,
  l_quantity::bigint as clicks, l_quantity::bigint * 100 as impressions, 1 as conversions from lineitem join campaigns on campaign_id = l_suppkey"""


@query("a11_entity_rollup", "campaigns", f"""
select account_id, campaign_id, ad_set_id, grouping(account_id, campaign_id, ad_set_id)::bigint as level, {SUMS} from ({AD_LEVEL}) group by rollup(account_id, campaign_id, ad_set_id)""",
       r="spend revenue", digits=1)
def _(t):
    return A.entity_rollup(ad_level(t)).withColumn("level", F.col("level").cast("bigint"))


@query("a12_fleet_stats", "scored campaign_state", """
select (select sum(current_budget) from campaign_state) as current_budget, (select avg(roas) from campaign_state) as avg_roas,
  avg(overall_score) as avg_health, count(*) as clients from scored""", r="current_budget avg_roas avg_health")
def _(t):
    money = A.budget_fleet(t.campaign_state.withColumn("recommended_budget", F.col("current_budget")))
    return A.health_fleet(t.scored).withColumns({"current_budget": money.select("current_budget").scalar(), "avg_roas": money.select("avg_roas").scalar()})


@query("a14_unique_users_exact", "", "select segment, count(distinct user_id) as users from (select event_type as segment, user_id from events) group by 1")
def _(t):
    return A.audience_size(t.raw("events").select(F.col("event_type").alias("segment"), "user_id"), exact=True)


NEAR_USERS = "select event_type as segment, count(distinct user_id) as exact, true as within_error from events group by 1"


def near_exact(t, sizes, error):
    """Estimates beside the exact counts: do they keep to the error?"""
    exact = A.audience_size(t.raw("events").select(F.col("event_type").alias("segment"), "user_id"), exact=True).withColumnRenamed("users", "exact")
    return exact.join(sizes, "segment").select("segment", "exact", (F.abs(F.col("users") - F.col("exact")) <= error * F.col("exact")).alias("within_error"))


@query("a14_unique_users_approx", "", NEAR_USERS)
def _(t):
    sizes = A.audience_size(t.raw("events").select(F.col("event_type").alias("segment"), "user_id"))
    return near_exact(t, sizes, 0.15)  # three standard errors


@query("a14_unique_users_sketch", "", NEAR_USERS)
def _(t):
    s = A.audience_sketches(t.raw("events").select(F.col("event_type").alias("segment"), "user_id"))
    return near_exact(t, s.select("segment", F.hll_sketch_estimate("sketch").alias("users")), 0.06)


@query("a15_interaction_stats", "interactions", """
select client_id, count(*) filter (interaction_type = 'support_ticket') as tickets_30d, count(*) filter (interaction_type = 'meeting') as meetings_30d,
  count(*) filter (interaction_type = 'dashboard_login') as logins_30d, avg(response_hours) as avg_response_hours, avg(sentiment) as avg_sentiment
from interactions where occurred_at::date > date '2001-08-01' - 30 and occurred_at::date <= date '2001-08-01' group by 1""", r="avg_response_hours avg_sentiment")
def _(t):
    return A.interaction_stats(t.interactions, AS_OF_ORDERS)


@query("a16_feature_adoption", "interactions", "select client_id, count(distinct interaction_type) / 7::double * 100 as feature_adoption from interactions group by 1", r="feature_adoption")
def _(t):
    return A.feature_adoption(t.interactions.select("client_id", F.col("interaction_type").alias("feature")), 7)


@query("a16_support_sentiment", "interactions", "select client_id, avg(sentiment) as support_sentiment_avg from interactions where interaction_type = 'support_ticket' group by 1", r="support_sentiment_avg")
def _(t):
    return A.support_sentiment(t.interactions)


@query("a17_video_engagement", "ad_metrics", """
with s as (select campaign_id, sum(impressions) as impressions, sum(clicks * 20) as views, sum(clicks * 15) as v2, sum(clicks * 12) as p25, sum(clicks * 9) as p50,
  sum(clicks * 5 + conversions) as p75, sum(clicks * 3) as p100, sum(clicks) as likes, sum(conversions) as comments, sum(clicks // 2) as shares from ad_metrics group by 1)
select campaign_id, p25 / greatest(views, 1)::double as retention_p25, p50 / greatest(views, 1)::double as retention_p50, p75 / greatest(views, 1)::double as retention_p75,
  p100 / greatest(views, 1)::double as retention_p100, v2 / greatest(views, 1)::double as hook_rate, p100 / greatest(views, 1)::double as completion_rate,
  (likes + comments + shares) / greatest(impressions, 1)::double as engagement_rate, shares / greatest(impressions, 1)::double as share_rate from s""",
       r="retention_p25 retention_p50 retention_p75 retention_p100 hook_rate completion_rate engagement_rate share_rate", digits=6)
def _(t):
    k = F.col("clicks")
    rows = t.ad_metrics.select("campaign_id", "impressions", (k * 20).alias("views"), (k * 15).alias("views_2s"), (k * 12).alias("p25"), (k * 9).alias("p50"),
                               (k * 5 + F.col("conversions")).alias("p75"), (k * 3).alias("p100"), k.alias("likes"), F.col("conversions").alias("comments"),
                               F.floor(k / 2).alias("shares"))
    return A.video_engagement(rows, ["campaign_id"])


@query("a18_breakdown", "touchpoints", f"""
with r as (select channel, json_extract_string(props, '$.k')::int % 3 as age, cost as spend, case when is_conversion then e.value else 0 end as revenue, 1 as clicks, 1 as impressions,
  is_conversion::int as conversions from touchpoints t join events e using (event_id))
select *, {KPI} from (select 'channel' as dimension, channel as value, {SUMS} from r group by 2 union all select 'age', age::varchar, {SUMS} from r group by 2)""",
       r=f"spend revenue {KPI_COLS}", digits=3)
def _(t):
    one = F.lit(1).cast("bigint")
    rows = t.touch_events.select(
        "channel", "props", F.col("cost").alias("spend"), F.when(F.col("is_conversion"), F.col("value")).otherwise(0.0).alias("revenue"),
        one.alias("clicks"), one.alias("impressions"), F.col("is_conversion").cast("bigint").alias("conversions"))
    return A.breakdown(rows, {"channel": F.col("channel"), "age": F.get_json_object("props", "$.k").cast("int") % 3})


@query("a19_conversions_by_weekday", "touchpoints", """
select weekday, n as conversions, n / sum(n) over ()::double as share, weekday >= 5 as is_weekend
from (select isodow(ts) - 1 as weekday, count(*) as n from touchpoints where is_conversion group by 1)""", r="share")
def _(t):
    return A.conversions_by_weekday(t.touchpoints.where("is_conversion"), "ts").withColumn("weekday", F.col("weekday").cast("bigint"))


# ---- time series ---------------------------------------------------------------------------

RANKED = """select *, revenue / greatest(spend, 1) as roas, clicks / greatest(impressions, 1)::double as ctr, conversions / greatest(clicks, 1)::double as cvr,
  row_number() over (partition by campaign_id order by day desc) as rn from ad_metrics"""


@query("w01_campaign_series_features", "ad_metrics", f"""
select campaign_id, sum(revenue) / greatest(sum(spend), 1) as roas_total,
  case when count(*) >= 7 then avg(roas) filter (rn <= 7) else sum(revenue) / greatest(sum(spend), 1) end as roas_7d_avg,
  case when count(*) >= 30 then avg(roas) filter (rn <= 30) else sum(revenue) / greatest(sum(spend), 1) end as roas_30d_avg,
  case when count(*) >= 7 then regr_slope(case when rn <= 7 then roas end, -rn) else 0 end as roas_trend_7d,
  case when count(*) >= 7 then avg(ctr) filter (rn <= 7) else sum(clicks) / greatest(sum(impressions), 1)::double end as ctr_7d_avg,
  case when count(*) >= 7 then avg(cvr) filter (rn <= 7) else sum(conversions) / greatest(sum(clicks), 1)::double end as cvr_7d_avg,
  case when count(*) >= 7 then regr_slope(case when rn <= 7 then cvr end, -rn) else 0 end as cvr_trend_7d,
  case when count(*) > 1 then stddev_pop(spend) else 0 end as spend_volatility, case when count(*) > 1 then stddev_pop(roas) else 0 end as roas_volatility
from ({RANKED}) group by 1""", r="roas_total roas_7d_avg roas_30d_avg roas_trend_7d ctr_7d_avg cvr_7d_avg cvr_trend_7d spend_volatility roas_volatility")
def _(t):
    return W.campaign_series_features(t.ad_metrics)


@query("w05_ctr_percentile", "ad_metrics campaigns", f"""
select campaign_id, day, industry, percent_rank() over (partition by industry order by clicks / greatest(impressions, 1)::double) as ctr_percentile
from ({WITH_IND})""", r="ctr_percentile", digits=6)
def _(t):
    rows = kpis(metrics_with_industry(t)).select("campaign_id", "day", "industry", "ctr")
    return W.percentile_in_group(rows, "industry", "ctr", "ctr_percentile").drop("ctr")


@query("w06_payment_delay_trend", "snapshots", """
select client_id, case when count(*) < 2 then 0 else regr_slope(health_score, datediff('day', date '1995-01-01', snapshot_date)) end as slope from snapshots group by 1""", r="slope")
def _(t):
    return W.slope(t.snapshots.withColumn("health_score", F.col("health_score").cast("double")), ["client_id"],
                   F.datediff("snapshot_date", F.lit("1995-01-01").cast("date")), "health_score", "slope")


EMA = "sum(case when rn = n then pow(1 - {a}, rn - 1) else {a} * pow(1 - {a}, rn - 1) end * roas)"
SIZED = "select *, count(*) over (partition by campaign_id) as n, least(7, count(*) over (partition by campaign_id)) as n7 from campaign_series"
STATS = f"""select campaign_id, max(n) as n, sum(case when rn > 7 then 0 when rn = n7 then pow(0.5::double, rn - 1) else 0.5::double * pow(0.5::double, rn - 1) end * roas) as ema_short,
  {EMA.format(a='0.25::double')} as ema_long, avg(roas) as mean, stddev_pop(roas) as sd from ({SIZED}) group by 1"""
TREND = "case when ema_short > ema_long * 1.05 then 'improving' when ema_short < ema_long * 0.95 then 'declining' else 'stable' end"


@query("w07_ema", "campaign_series", f"select campaign_id, {EMA.format(a='0.4::double')} as ema from ({SIZED}) group by 1", r="ema")
def _(t):
    return W.ema(t.campaign_series, "campaign_id", "roas", 4)


@query("w08_trend", "campaign_series", f"select campaign_id, ema_short, ema_long, {TREND} as trend from ({STATS})", r="ema_short ema_long")
def _(t):
    return W.series_stats(t.campaign_series).select("campaign_id", "ema_short", "ema_long", W.trend_of(F.col("ema_short"), F.col("ema_long")).alias("trend"))


@query("w09_coef_variation", "campaign_series", f"""
select campaign_id, case when n < 2 then 0.5::double when mean = 0 then 1 else least(1, sd / mean) end as cv from ({STATS})""", r="cv")
def _(t):
    return W.series_stats(t.campaign_series).select("campaign_id", W.coef_variation(F.col("n"), F.col("mean"), F.col("sd")).alias("cv"))


R1 = rnd(f"""s.roas * (1 + (case {TREND} when 'improving' then 1.05::double when 'declining' then 0.95::double else 1 end - 1) * 0.1::double)""", 2)
R2 = rnd(f"""s.roas * 0.8::double + mean * 0.2::double""", 2)
R3 = rnd(f"""mean * 0.7::double + ema_long * 0.3::double""", 2)
R4 = rnd(f"""greatest(0.3::double, least(0.95::double, 1 - case when mean = 0 then 1 else least(1, sd / mean) end))""", 2)
FORECAST = f"""select s.*, case when coalesce(n, 0) < 3 then 'stable' else {TREND} end as trend,
  case when coalesce(n, 0) < 3 then s.roas * 0.98::double else {R1} end as roas_1h,
  case when coalesce(n, 0) < 3 then s.roas * 0.95::double else {R2} end as roas_6h,
  case when coalesce(n, 0) < 3 then s.roas * 0.90::double else {R3} end as roas_24h,
  case when coalesce(n, 0) < 3 then 0.3::double else {R4} end as forecast_confidence
  from campaign_state s left join ({STATS}) st using (campaign_id)"""


def forecasts(t):
    return W.forecast(W.series_stats(t.campaign_series), t.campaign_state)


@query("w10_forecast", "campaign_state", f"select campaign_id, trend, roas_1h, roas_6h, roas_24h, forecast_confidence from ({FORECAST})")
def _(t):
    return forecasts(t).select("campaign_id", "trend", "roas_1h", "roas_6h", "roas_24h", "forecast_confidence")


@query("w11_revenue_mom_change", "", """
with m as (select o_custkey as client_id, date_trunc('month', o_orderdate)::date as month, sum(o_totalprice) as revenue from orders group by 1, 2)
select *, (revenue - lag(revenue) over w) / nullif(lag(revenue) over w, 0) as revenue_mom_change from m window w as (partition by client_id order by month)""", r="revenue revenue_mom_change", digits=3)
def _(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("client_id"), "o_orderdate", "o_totalprice")
    return W.month_over_month(o, "client_id", "o_orderdate", "o_totalprice")


@query("w12_roas_change", "ad_metrics", """
with m as (select campaign_id, day, revenue / greatest(spend, 1) as roas from ad_metrics)
select *, (roas - lag(roas) over w) / nullif(lag(roas) over w, 0) as roas_change from m window w as (partition by campaign_id order by day)""", r="roas roas_change")
def _(t):
    return W.roas_change(t.ad_metrics)


@query("w13_health_trends", "snapshots", """
with g as (select client_id, count(*) as snapshots, case when count(*) < 2 then 0 else regr_slope(health_score, datediff('day', date '2000-12-31', snapshot_date)) * 7 end as avg_weekly_change
  from snapshots where snapshot_date > date '2000-12-31' - 365 and snapshot_date <= date '2000-12-31' group by 1)
select *, case when avg_weekly_change > 1e-9 then 'improving' when avg_weekly_change < -1e-9 then 'declining' else 'stable' end as direction from g""", r="avg_weekly_change", digits=3)
def _(t):
    return W.health_trends(t.snapshots, "2000-12-31", 365)


DRIFT = """select *, abs(recent_mean - historical_mean) / (historical_mean + 1e-6) as drift_score, abs(recent_mean - historical_mean) / (historical_mean + 1e-6) > 0.15 as drift_detected from (
  select model, max(n) as n, avg(prediction) filter (rn > n - n // 2) as historical_mean, avg(prediction) filter (rn <= n - n // 2) as recent_mean from (
    select *, count(*) over (partition by model) as n from (
      select *, row_number() over (partition by model order by ts desc, id desc) as rn from predictions) where rn <= 1000) group by 1) where n >= 100"""


@query("w14_drift", "predictions", DRIFT, r="historical_mean recent_mean drift_score")
def _(t):
    return W.drift(t.predictions)


@query("w15_rolling_counts", "", """
with d as (select user_id, ts::date as day, count(*) as events from events group by 1, 2)
select *, (sum(events) over (partition by user_id order by day range between interval 6 day preceding and current row))::bigint as events_7d,
  (sum(events) over (partition by user_id order by day range between interval 29 day preceding and current row))::bigint as events_30d from d""")
def _(t):
    return W.rolling_counts(t.raw("events"), "user_id", "ts", [7, 30])


@query("w16_days_since_last", "", f"select user_id, datediff('day', max(ts)::date, date '{AS_OF_EVENTS}') as days_since_last from events where event_type = 'purchase' group by 1")
def _(t):
    out = W.days_since_last(t.raw("events").where("event_type = 'purchase'"), "user_id", "ts", AS_OF_EVENTS)
    return out.withColumn("days_since_last", F.col("days_since_last").cast("bigint"))


@query("w19_sessionize", "event_gaps", """
select user_id, session_no, min(ts) as started_at, max(ts) as ended_at, count(*) as events, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as duration_s from (
  select *, sum(case when prev_ts is null or epoch_us(ts) - epoch_us(prev_ts) > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id)::bigint as session_no
  from event_gaps) group by 1, 2""", r="duration_s")
def _(t):
    return W.sessionize(t.raw("events"))
