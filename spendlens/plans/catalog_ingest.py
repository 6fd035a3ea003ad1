"""Registered queries: sources, sinks, normalisation and data quality."""

from pyspark.sql import functions as F

from spendlens import schemas
from spendlens.operators import normalize as N
from spendlens.operators import quality as Q
from spendlens.plans.registry import query
from spendlens.plans.views import PLATFORMS, pick
from spendlens.session import shared_scratch, staged
from spendlens.sources import landed as L
from spendlens.sources import sinks as K

RAW = {"meta": "raw_meta", "google": "raw_google", "tiktok": "raw_tiktok"}


def raw_campaigns(t, source):
    return getattr(t, RAW[source])


def norm_campaigns(t):
    return N.unify_sources(*[N.normalize_campaigns(raw_campaigns(t, s), s) for s in PLATFORMS])


def norm_metrics(t):
    daily = staged(t.ad_metrics, "daily")  # one scan and aggregation for the three platforms
    return N.unify_sources(*[N.normalize_metrics(t.raw_metrics(s, daily), s, ["campaign_id", "day"]) for s in PLATFORMS])


def json_lines(df):
    return df.select(F.to_json(F.struct("*")).alias("value"))


# ---- sources -------------------------------------------------------------------------------

for _s, _cols in {"meta": "campaign_id, id, name, objective, status, daily_budget, lifetime_budget, start_time, stop_time",
                  "google": "campaign_id, name, status, advertising_channel_type, budget_amount, start_date, end_date",
                  "tiktok": "campaign_id, campaign_name, objective_type, status, budget, budget_mode"}.items():
    @query(f"s01_read_campaigns_{_s}", RAW[_s], f"select {_cols} from {RAW[_s]}")
    def _(t, s=_s, cols=_cols):
        return L.parse_lines(json_lines(raw_campaigns(t, s)), schemas.RAW_CAMPAIGNS[s]).select(*cols.split(", "))


@query("s02_read_insights_default_week", "ad_metrics", """
select campaign_id, day, impressions, clicks, conversions, spend, revenue from ad_metrics where day between date '2000-06-23' and date '2000-06-30'
""", r="spend revenue")
def _(t):
    return L.insights(t.ad_metrics, as_of="2000-06-30")


@query("s02_read_insights_entity", "ad_metrics", """
select * from ad_metrics where campaign_id = 7 and day between date '1999-01-01' and date '1999-12-31'""", r="spend revenue")
def _(t):
    return L.insights(t.ad_metrics, "2000-01-01", "1999-01-01", "1999-12-31", ("campaign_id", 7))


@query("s03_status_filter", "raw_google", "select campaign_id, status from raw_google where status in ('PAUSED')")
def _(t):
    return L.filter_status(t.raw_google, ["PAUSED"]).select("campaign_id", "status")


@query("s04_sync_counts", "campaigns ad_sets ads", """
select n.n_nationkey::bigint as account_id, count(distinct c.campaign_id) as campaigns, count(distinct s.ad_set_id) as ad_sets, count(distinct a.ad_id) as ads
from nation n left join campaigns c on n.n_nationkey = c.account_id left join ad_sets s on c.campaign_id = s.campaign_id
left join ads a on s.ad_set_id = a.ad_set_id group by 1""")
def _(t):
    return L.sync_counts(t.accounts, t.campaigns, t.ad_sets, t.ads)


@query("s05_read_customer_csv", "", """
select sha256('user' || user_id || '@example.com') as email_hash, value as purchase_value, ts::date as purchase_date from events where event_type = 'purchase'
""", r="purchase_value")
def _(t):
    e = t.raw("events").where("event_type = 'purchase'")
    line = F.concat_ws(",", F.concat(F.lit('" User'), F.col("user_id").cast("string"), F.lit('@Example.com "')), F.col("value").cast("string"),
                       F.date_format("ts", "yyyy-MM-dd"))
    return L.parse_customer_lines(e.select(line.alias("value")))


def metric_rows(t):
    return t.ad_metrics.select(F.lit("campaign").alias("entity_type"), F.col("campaign_id").alias("entity_id"), "day", "impressions", "clicks",
                               "conversions", "spend", "revenue")


@query("s06_write_metrics_by_month", "ad_metrics", """
select strftime(day, '%Y-%m') as month, count(*) as rows, sum(clicks)::bigint as clicks, sum(spend) as spend from ad_metrics group by 1""", r="spend", digits=2)
def _(t):
    path = shared_scratch(t.spark, "metrics")
    K.write_metrics(metric_rows(t), path)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("clicks").alias("clicks"), F.sum("spend").alias("spend"))


UPSERT_SQL = """
select campaign_id, status, case when campaign_id % 4 = 0 then budget * 2 else budget end as budget,
  case when campaign_id % 4 = 0 then '2024-02-01' else '2024-01-01' end as updated_at from campaigns"""


def upsert_sides(t):
    base = t.campaigns.select("campaign_id", "status", "budget", F.lit("2024-01-01").alias("updated_at"))
    change = base.where("campaign_id % 4 = 0")
    updates = change.withColumn("budget", F.col("budget") * 3).unionByName(
        change.withColumns({"budget": F.col("budget") * 2, "updated_at": F.lit("2024-01-15")}))
    return base, updates


@query("s07_upsert", "campaigns", UPSERT_SQL, r="budget")
def _(t):
    base, updates = upsert_sides(t)
    return K.upsert(base, updates, ["campaign_id"], F.lit("2024-02-01"))


@query("s07_upsert_partitions", "campaigns", UPSERT_SQL.replace("from campaigns", ", campaign_id % 5 as part from campaigns"), r="budget")
def _(t):
    base, updates = upsert_sides(t)
    part = (F.col("campaign_id") % 5).cast("int")
    path = shared_scratch(t.spark, "campaigns")
    base.withColumn("part", part).write.partitionBy("part").parquet(path)
    K.upsert_partitions(path, updates.withColumn("part", part), ["campaign_id", "part"], F.lit("2024-02-01"), "part")
    return t.spark.read.parquet(path).withColumn("part", F.col("part").cast("bigint"))


def segment_members(t):
    return t.raw("events").select(F.when(F.col("event_type") == "purchase", "buyers").otherwise("visitors").alias("segment"), "user_id").distinct()


MEMBERS = "select distinct case when event_type = 'purchase' then 'buyers' else 'visitors' end as segment, user_id from events"


@query("s08_export_audience_rows", "contacts", f"""
select segment, 'meta' as platform, user_id, sha256(lower(trim(email))) as email_hash, email not like '%@%' as is_invalid
from ({MEMBERS}) join contacts using (user_id)""")
def _(t):
    return K.audience_members(segment_members(t), t.contacts, "meta")


@query("s08_export_audience_counts", "contacts", f"""
select segment, 'meta' as platform, count(*) as num_received, count(*) filter (email not like '%@%') as num_invalid
from ({MEMBERS}) join contacts using (user_id) group by 1""")
def _(t):
    return K.export_audience(segment_members(t), t.contacts, "meta", shared_scratch(t.spark, "audience"))


@query("s09_write_read_features", "ad_metrics", """
select 'campaign' as entity_type, '7' as entity_id, f as feature, v as value from (
  select sum(spend) as spend, sum(clicks)::double as clicks from ad_metrics where campaign_id = 7) unpivot (v for f in (spend, clicks))""", r="value", digits=2)
def _(t):
    wide = t.ad_metrics.groupBy("campaign_id").agg(F.sum("spend").alias("spend"), F.sum("clicks").alias("clicks"))
    path = shared_scratch(t.spark, "features")
    K.write_features(N.long_features(wide, "campaign", "campaign_id"), path)
    return K.read_features(t.spark, path, "campaign", "7").select("entity_type", "entity_id", "feature", "value")


@query("s10_append_predictions", "predictions", "select model::varchar as model, count(*) as rows, sum(prediction) as total from predictions group by 1", r="total")
def _(t):
    path = shared_scratch(t.spark, "predictions")
    rows = t.predictions.withColumn("features", F.create_map(F.lit("price"), F.col("prediction")))
    K.append_log(rows, path, schemas.PREDICTION_LOG, "ts", F.lit("2024-01-31").cast("timestamp"))
    return t.spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.sum("prediction").alias("total"))


@query("s11_append_actuals", "actuals", "select model::varchar as model, count(*) as rows, sum(actual) as total from actuals group by 1", r="total")
def _(t):
    path = shared_scratch(t.spark, "actuals")
    K.append_log(t.actuals, path, schemas.ACTUAL_LOG, "logged_at", F.lit("2024-01-31").cast("timestamp"))
    return t.spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.sum("actual").alias("total"))


@query("s13_keyword_report", "keywords", """
select keyword, match_type, sum(i)::bigint as impressions, sum(c)::bigint as clicks, sum(n)::bigint as conversions, sum(s) as spend, avg(quality_score) as quality_score
from keywords join (select l_partkey, sum(l_quantity::bigint * 100) as i, sum(l_quantity::bigint) as c, count(*) as n, sum(l_extendedprice * 0.02) as s
  from lineitem where l_shipdate::date between date '1996-01-01' and date '1998-12-31' group by 1) on l_partkey = keyword_id group by 1, 2""", r="spend quality_score")
def _(t):
    return L.keyword_report(t.keywords, t.keyword_metrics, "1996-01-01", "1998-12-31")


@query("s13_search_terms_report", "keywords", """
select search_term, keyword, match_type, sum(l_quantity::bigint * 100)::bigint as impressions, sum(l_quantity::bigint)::bigint as clicks
from lineitem join keywords on l_partkey = keyword_id group by 1, 2, 3""")
def _(t):
    terms = t.keyword_metrics.join(t.keywords.select("keyword_id", "search_term"), "keyword_id")
    return L.search_terms_report(terms, t.keywords)


@query("s14_log_interaction", "interactions", """
select interaction_type, count(*) as rows from interactions where interaction_type <> 'report_view' group by 1""")
def _(t):
    path = shared_scratch(t.spark, "interactions")
    K.log_interaction(t.interactions.where("interaction_type <> 'report_view'"), path)
    return t.spark.read.parquet(path).groupBy("interaction_type").agg(F.count(F.lit(1)).alias("rows"))


@query("s15_read_accounts", "", """
select 'act_' || n_nationkey as account_id, n_name as name, (['USD','EUR','GBP'])[n_nationkey % 3 + 1] as currency from nation""")
def _(t):
    a = t.accounts.select(F.concat(F.lit("act_"), F.col("account_id").cast("string")).alias("account_id"), "name",
                          pick(["USD", "EUR", "GBP"], F.col("account_id") % 3).alias("currency"), F.lit("UTC").alias("timezone"))
    return L.parse_lines(json_lines(a), schemas.ACCOUNTS).select("account_id", "name", "currency")


@query("s15_read_adsets_targeting", "ad_sets", """
select ad_set_id::varchar as adset_id, (18 + ad_set_id % 10)::int as age_min, (40 + ad_set_id % 20)::int as age_max, unnest(['US', 'C' || ad_set_id % 4]) as country from ad_sets""")
def _(t):
    i = F.col("ad_set_id")
    target = F.struct((i % 10 + 18).alias("age_min"), (i % 20 + 40).alias("age_max"), F.array(F.lit("US"), F.concat(F.lit("C"), (i % 4).cast("string"))).alias("countries"))
    rows = t.ad_sets.select(i.cast("string").alias("adset_id"), F.col("campaign_id").cast("string").alias("campaign_id"), target.alias("targeting"))
    return L.parse_lines(json_lines(rows), schemas.AD_SETS).select("adset_id", "targeting.age_min", "targeting.age_max", F.explode("targeting.countries").alias("country"))


@query("s15_read_ads_headlines", "ads", """
select ad_id::varchar as ad_id, ad_set_id::varchar as adset_id, unnest(['H' || ad_id % 9, 'Second']) as headline from ads""")
def _(t):
    rows = t.ads.select(F.col("ad_id").cast("string").alias("ad_id"), F.col("ad_set_id").cast("string").alias("adset_id"),
                        F.array(F.concat(F.lit("H"), (F.col("ad_id") % 9).cast("string")), F.lit("Second")).alias("headlines"))
    return L.parse_lines(json_lines(rows), schemas.ADS).select("ad_id", "adset_id", F.explode("headlines").alias("headline"))


@query("s15_read_creatives", "creatives", "select creative_id::varchar as creative_id, md5(headline) as title_md5, md5(body) as body_md5, cta as call_to_action from creatives")
def _(t):
    rows = t.creatives.select(F.col("creative_id").cast("string").alias("creative_id"), F.col("headline").alias("title"), "body", F.col("cta").alias("call_to_action"))
    return L.parse_lines(json_lines(rows), schemas.CREATIVES).select("creative_id", F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"), "call_to_action")


# ---- normalisation -------------------------------------------------------------------------

for _i, _s in enumerate(PLATFORMS):
    @query(f"n0{_i + 1}_normalize_campaigns_{_s}", "norm_campaigns", f"select * from norm_campaigns where platform = '{_s}'")
    def _(t, s=_s):
        return N.normalize_campaigns(raw_campaigns(t, s), s)

    @query(f"n0{_i + 5}_normalize_metrics_{_s}", "norm_metrics", f"select * from norm_metrics where platform = '{_s}'",
           r="spend conversions conversion_value ctr cpc cpm")
    def _(t, s=_s):
        return N.normalize_metrics(t.raw_metrics(s), s, ["campaign_id", "day"])


@query("n04_pass_through", "", "select c_custkey, c_name, c_acctbal from customer")
def _(t):
    return N.normalize_campaigns(t.raw("customer"), "crm").select("c_custkey", "c_name", "c_acctbal")


DERIVED = """select campaign_id, day, platform, conversion_value / greatest(spend, 0.01) as roas,
  conversions / greatest(clicks, 1) * 100 as cvr_pct, spend / greatest(conversions, 1) as cpa from norm_metrics"""


@query("n08_derive_metrics", "norm_metrics", DERIVED, r="roas cvr_pct cpa")
def _(t):
    return N.derive_metrics(norm_metrics(t)).select("campaign_id", "day", "platform", "roas", "cvr_pct", "cpa")


@query("n09_transform_google_metrics", "norm_metrics", DERIVED + " where platform = 'google'", r="roas cvr_pct cpa")
def _(t):
    return N.transform(t.raw_metrics("google"), "google", "metrics", ["campaign_id", "day"]).select("campaign_id", "day", "platform", "roas", "cvr_pct", "cpa")


KPI = """clicks / greatest(impressions, 1)::double as ctr, conversions / greatest(clicks, 1)::double as cvr, spend / greatest(clicks, 1) as cpc,
  spend / greatest(impressions, 1) * 1000 as cpm, spend / greatest(conversions, 1) as cpa, revenue / greatest(spend, 1) as roas"""
KPI_COLS = "ctr cvr cpc cpm cpa roas"


@query("n10_kpis", "ad_metrics", f"select campaign_id, day, {KPI} from ad_metrics", r=KPI_COLS)
def _(t):
    return N.kpis(t.ad_metrics).select("campaign_id", "day", *KPI_COLS.split())


@query("n11_unify_sources", "norm_campaigns", "select * from norm_campaigns", r="daily_budget lifetime_budget")
def _(t):
    return norm_campaigns(t)


@query("n12_temporal_features", "", """
with e as (select event_id, hour(ts) as hour, (isodow(ts) - 1) as day_of_week, day(ts) as day_of_month, month(ts) as month from events)
select *, sin(2 * pi() * hour / 24) as hour_sin, cos(2 * pi() * hour / 24) as hour_cos, sin(2 * pi() * day_of_week / 7) as dow_sin,
  cos(2 * pi() * day_of_week / 7) as dow_cos, sin(2 * pi() * month / 12) as month_sin, cos(2 * pi() * month / 12) as month_cos,
  (day_of_week >= 5)::int as is_weekend, (day_of_month <= 7)::int as is_month_start, (day_of_month >= 25)::int as is_month_end from e""",
       r="hour_sin hour_cos dow_sin dow_cos month_sin month_cos")
def _(t):
    return N.temporal_features(t.raw("events").select("event_id", "ts"), "ts").drop("ts")


@query("n13_is_holiday", "ad_metrics", """
select campaign_id, day, strftime(day, '%m-%d') in ('01-01', '12-25') as is_holiday from ad_metrics""")
def _(t):
    days = t.ad_metrics.select("day").distinct()
    holidays = days.where(F.date_format("day", "MM-dd").isin("01-01", "12-25")).select(F.lit("US").alias("country"), "day")
    return N.is_holiday(t.ad_metrics.select("campaign_id", "day", F.lit("US").alias("country")), holidays, "day", "country").drop("country")


@query("n14_client_features", "client_features", """
select client_id, monthly_spend, revenue_mom_change, current_roas / greatest(target_roas, 0.1) as roas_vs_target, logins_7d as login_count_7d,
  logins_30d as login_count_30d, logins_30d / 30::double as login_frequency, response_hours as response_time_hours, last_contact_days as days_since_contact,
  meeting_rate as meeting_attendance_rate, payment_delay_days as payment_delay_avg, invoices_outstanding, tenure_months,
  coalesce(contract_days_remaining, 365) as contract_days_remaining, is_month_to_month::bigint as is_month_to_month from client_features""",
       r="monthly_spend revenue_mom_change roas_vs_target login_frequency meeting_attendance_rate payment_delay_avg")
def _(t):
    return N.client_features(t.client_features)


@query("n15_compute_features", "ad_metrics creatives client_features", f"""
with c as (select campaign_id::varchar as id, sum(spend) as spend, sum(revenue) as revenue, sum(clicks) as clicks, sum(impressions) as impressions,
    sum(conversions) as conversions from ad_metrics group by 1), k as (select id, {KPI} from c)
select 'campaign' as entity_type, id as entity_id, f as feature, v as value from k unpivot (v for f in (ctr, cvr, cpc, cpm, cpa, roas))
union all select 'creative', creative_id::varchar, 'headline_length', length(headline)::double from creatives
union all select 'client', client_id::varchar, 'login_frequency', logins_30d / 30::double from client_features""", r="value")
def _(t):
    c = t.ad_metrics.groupBy("campaign_id").agg(*[F.sum(m).alias(m) for m in ("spend", "revenue", "clicks", "impressions", "conversions")])
    return N.compute_features(
        N.kpis(c).select("campaign_id", *KPI_COLS.split()), t.creatives.select("creative_id", F.length("headline").alias("headline_length")),
        N.client_features(t.client_features).select("client_id", "login_frequency"))


@query("n16_budget_utilization", "campaign_state", """
select campaign_id, spend_today / current_budget as budget_util, (1 - spend_today / current_budget) * 100 as budget_remaining_percent from campaign_state
""", r="budget_util budget_remaining_percent")
def _(t):
    return N.budget_utilization(t.campaign_state, "spend_today", "current_budget").select("campaign_id", "budget_util", "budget_remaining_percent")


# ---- quality -------------------------------------------------------------------------------

def dirty_campaigns(t):
    """Campaigns with missing ids and names and an unknown platform on some rows."""
    k = F.col("campaign_id")
    return t.campaigns.select(k.alias("seq"), F.when(k % 5 != 0, k.cast("string")).alias("external_id"), F.when(k % 7 != 0, F.col("campaign_name")).alias("name"),
                              F.when(k % 11 == 0, "bing").otherwise(F.col("platform")).alias("platform"))


DIRTY_C = """select campaign_id as seq, case when campaign_id % 5 <> 0 then campaign_id::varchar end as external_id,
  case when campaign_id % 7 <> 0 then campaign_name end as name, case when campaign_id % 11 = 0 then 'bing' else platform end as platform from campaigns"""


def dirty_metrics(t):
    k = F.col("campaign_id")
    return t.ad_metrics.select("campaign_id", "day", F.when(k % 9 == 0, -F.col("impressions")).otherwise(F.col("impressions")).alias("impressions"),
                               F.when(k % 10 != 0, F.col("clicks")).alias("clicks"), "spend")


DIRTY_M = """select campaign_id, day, case when campaign_id % 9 = 0 then -impressions else impressions end as impressions,
  case when campaign_id % 10 <> 0 then clicks end as clicks, spend from ad_metrics"""


@query("q01_validate_campaigns", "campaigns", f"""
select seq, external_id is not null and name is not null and platform in ('meta','google','tiktok') as is_valid from ({DIRTY_C})""")
def _(t):
    return Q.validate(dirty_campaigns(t), Q.rules_for("campaigns")).select("seq", "is_valid")


@query("q02_validate_metrics", "ad_metrics", f"""
select campaign_id, day, impressions >= 0 and coalesce(clicks, -1) >= 0 and spend >= 0 as is_valid from ({DIRTY_M})""")
def _(t):
    return Q.validate(dirty_metrics(t), Q.rules_for("metrics")).select("campaign_id", "day", "is_valid")


@query("q03_validation_summary", "ad_metrics", f"""
select count(*) as total_records, count(*) filter (ok) as valid_records, count(*) filter (not ok) as invalid_records, count(*) filter (not ok) = 0 as valid
from (select impressions >= 0 and coalesce(clicks, -1) >= 0 and spend >= 0 as ok from ({DIRTY_M}))""")
def _(t):
    return Q.validation_summary(dirty_metrics(t), Q.rules_for("metrics"))


@query("q03_validation_errors", "campaigns", f"""
with d as ({DIRTY_C})
select seq, 'external_id_required' as rule from d where external_id is null union all select seq, 'name_required' from d where name is null
union all select seq, 'platform_valid' from d where platform not in ('meta','google','tiktok')""")
def _(t):
    return Q.validation_errors(dirty_campaigns(t), Q.rules_for("campaigns")).select("seq", "rule")


def repeated_rows(t):
    """Line items as records with a repeated, sometimes missing, key."""
    return t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_seq"), F.col("l_extendedprice").alias("amount"),
                                    F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("external_id"), F.col("l_returnflag").alias("platform"),
                                    "l_partkey")


DUP = """select l_orderkey * 10 + l_linenumber as ingest_seq, l_extendedprice as amount, case when l_suppkey % 10 <> 0 then l_suppkey end as external_id,
  l_returnflag as platform, l_partkey from lineitem"""


@query("q04_dedupe_keep_first", "", f"""
select * from ({DUP}) qualify row_number() over (partition by external_id, platform order by ingest_seq, l_partkey, amount) = 1""")
def _(t):
    return Q.dedupe(repeated_rows(t), ["external_id", "platform"], ["ingest_seq", "l_partkey", "amount"])


@query("q05_dedupe_nested", "", f"""
select ingest_seq, amount, external_id, platform from ({DUP}) qualify row_number() over (partition by external_id, platform order by ingest_seq, l_partkey, amount) = 1""")
def _(t):
    nested = repeated_rows(t).withColumn("ident", F.struct("external_id", F.array("platform").alias("tags")))
    return Q.dedupe_nested(nested, ["ident"], ["ingest_seq", "l_partkey", "amount"]).select("ingest_seq", "amount", "external_id", "platform")


@query("q06_changed_only", "", """
with b as (select o_orderkey as seq, o_custkey as id, o_orderstatus as status, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as prev from orders),
  s as (select c_custkey as id, 'O' as stored from customer where c_custkey % 2 = 0)
select seq, b.id, status from b left join s on b.id = s.id where status is distinct from coalesce(prev, stored)""")
def _(t):
    batch = t.raw("orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))
    seen = t.raw("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("O").alias("status"))
    previous = seen.select("id", Q.checksum(["id", "status"]).alias("checksum"))
    return Q.changed_only(batch, previous, "id", "seq", ["id", "status"], bucket_rows=5000).drop("checksum")


SYNCED = "select o_orderstatus as source, date '1998-01-01' + (case o_orderstatus when 'F' then 0 else 365 end)::int as synced_at from (values ('F'), ('O')) v(o_orderstatus)"


def sync_marks(t):
    o = t.raw("orders").where("o_orderstatus in ('F', 'O')").select(F.col("o_orderstatus").alias("source")).distinct()
    return o.withColumn("synced_at", F.date_add(F.lit("1998-01-01").cast("date"), F.when(F.col("source") == "F", 0).otherwise(365)))


def dated_orders(t):
    return t.raw("orders").select("o_orderkey", F.col("o_orderstatus").alias("source"), F.col("o_orderdate").cast("date").alias("updated_at"))


@query("q07_since", "", f"""
select o_orderkey, o_orderstatus as source, o_orderdate::date as updated_at from orders left join ({SYNCED}) on source = o_orderstatus
where synced_at is null or o_orderdate::date > synced_at""")
def _(t):
    return Q.since(dated_orders(t), sync_marks(t), "source", "updated_at")


@query("q07_mark_synced", "", """
select o_orderstatus as source, max(o_orderdate::date) as synced_at from orders group by 1""")
def _(t):
    return Q.mark_synced(dated_orders(t), sync_marks(t), "source", "updated_at")


@query("q08_check_constraints_interactions", "interactions", """
select interaction_id, 'interaction_type_enum' as rule from interactions where interaction_type not in
  ('slack_message','email','call','meeting','dashboard_login','support_ticket','payment')""")
def _(t):
    return Q.check_constraints(t.interactions, "client_interactions").select("interaction_id", "rule")


@query("q08_check_constraints_clients", "snapshots", """
with s as (select client_id, snapshot_date, health_score + 5 as health_score, churn_probability * 1.05 as churn_probability from snapshots)
select client_id, snapshot_date, 'health_score_range' as rule from s where health_score not between 0 and 100
union all select client_id, snapshot_date, 'churn_probability_range' from s where churn_probability not between 0 and 1""")
def _(t):
    s = t.snapshots.withColumns({"health_score": F.col("health_score") + 5, "churn_probability": F.col("churn_probability") * 1.05})
    return Q.check_constraints(s, "clients").select("client_id", "snapshot_date", "rule")


@query("q09_orphans", "", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 13 <> 0)")
def _(t):
    parent = t.raw("customer").where("c_custkey % 13 <> 0")
    return Q.orphans(t.raw("orders").select("o_orderkey", "o_custkey"), parent, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("q10_key_violations", "", "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1")
def _(t):
    return Q.key_violations(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("q11_run_log", "norm_campaigns norm_metrics", """
select platform as source, count(*) as records_processed, sum(c)::bigint as campaigns, count(*) filter (bad) as invalid_rows, 'completed' as status from (
  select platform, 1 as c, external_id is null or name is null as bad from norm_campaigns
  union all select platform, 0, impressions < 0 or clicks < 0 or spend < 0 from norm_metrics) group by 1
union all select 'crm', 0, 0, 0, 'failed'""")
def _(t):
    return Q.run_log(norm_campaigns(t), norm_metrics(t), ["crm"])


@query("q11_load_total", "norm_campaigns norm_metrics", """
select (select count(*) from (select distinct external_id, platform from norm_campaigns)) + (select count(*) from norm_metrics) as total_loaded""")
def _(t):
    return Q.load_total(norm_campaigns(t), norm_metrics(t), ["external_id", "platform"])
