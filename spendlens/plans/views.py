"""Domain tables derived from the given test tables, in Spark and as the oracle's CTEs.

Both sides state the same mapping; every registered query starts from one of these.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.functions.expr import hash_bucket, nz
from spendlens.functions.skew import one_row, spread
from spendlens.operators import attribution, audience, health

# Fixed values of the mapping.
CHANNELS = ["meta", "google", "tiktok", "email", "organic"]
PLATFORMS = ["meta", "google", "tiktok"]
INDUSTRIES = ["ecommerce", "saas", "finance", "healthcare", "education", "retail"]
CTAS = ["SHOP_NOW", "LEARN_MORE", "SIGN_UP", "BUY_NOW", "CONTACT_US"]
OBJECTIVES = ["CONVERSIONS", "TRAFFIC", "AWARENESS"]
AS_OF_ORDERS = "2001-08-01"
AS_OF_EVENTS = "2024-01-31"


def pick(values: list[str], index) -> F.col:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def first_sentence(text):
    return F.regexp_extract(text, r"^[^.!?\n]*[.!?]?", 0)


class Tables:
    """The given tables and the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def touchpoints(self) -> DataFrame:
        return self.touch_events.drop("event_type", "props")

    @cached_property
    def touch_events(self) -> DataFrame:
        """Touchpoints with the type and properties of their events, so that no query joins events for them."""
        k = F.get_json_object("props", "$.k").cast("int")
        e = self.raw("events").withColumn("channel", pick(CHANNELS, k % 5))
        return e.select(
            (F.col("user_id") % 5).alias("client_id"), "user_id", "event_id", "ts", "channel",
            (F.col("event_id") % 20).alias("campaign_id"),
            F.when(F.col("channel").isin("email", "organic"), 0.0).otherwise(F.floor(F.col("value") * 10) / 100).alias("cost"),
            (F.col("event_type") == "purchase").alias("is_conversion"), "value", "event_type", "props")

    @cached_property
    def journeys(self) -> DataFrame:
        return attribution.build_journeys(self.touchpoints)

    @cached_property
    def paths(self) -> DataFrame:
        return attribution.paths(self.journeys)

    @cached_property
    def path_channels(self) -> DataFrame:
        return attribution.path_channels(self.journeys)

    @cached_property
    def edges(self) -> DataFrame:
        return attribution.transition_edges(self.journeys)

    @cached_property
    def ad_metrics(self) -> DataFrame:
        q = F.col("l_quantity").cast("bigint")
        return self.raw("lineitem").groupBy(F.col("l_suppkey").alias("campaign_id"), F.col("l_shipdate").cast("date").alias("day")).agg(
            F.sum(q * 100).alias("impressions"), F.sum(q).alias("clicks"), F.count(F.lit(1)).alias("conversions"),
            F.sum(F.col("l_extendedprice") * (F.col("l_tax") + 0.02)).alias("spend"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))

    @cached_property
    def campaigns(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        k = F.col("s_suppkey")
        return j.select(
            k.alias("campaign_id"), F.col("s_name").alias("campaign_name"), pick(PLATFORMS, k % 3).alias("platform"),
            F.col("r_name").alias("industry"), F.col("s_nationkey").cast("bigint").alias("account_id"),
            F.col("r_regionkey").cast("bigint").alias("client_id"),
            (F.abs("s_acctbal") % 900 + 100).alias("budget"), F.when(k % 7 == 0, "paused").otherwise("active").alias("status"))

    @cached_property
    def campaign_series(self) -> DataFrame:
        """Daily ROAS of every campaign over all its days; rn 1 is the newest (a campaign-day is one row)."""
        newest = Window.partitionBy("campaign_id").orderBy(F.desc("day"))
        return self.ad_metrics.withColumn("rn", F.row_number().over(newest)).select(
            "campaign_id", "day", "rn", "spend", "revenue", "clicks", "impressions", "conversions",
            (F.col("revenue") / F.greatest("spend", F.lit(1.0))).alias("roas"))

    @cached_property
    def campaign_state(self) -> DataFrame:
        s = self.campaign_series.groupBy("campaign_id").agg(
            F.max(F.when(F.col("rn") == 1, F.col("roas"))).alias("roas"),
            F.max(F.when(F.col("rn") == 1, F.col("spend"))).alias("spend_today"),
            F.max(F.when(F.col("rn") == 1, F.col("revenue"))).alias("revenue"),
            F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("conversions").alias("conversions"))
        return self.campaigns.select("campaign_id", "campaign_name", "platform", "account_id", F.col("budget").alias("current_budget")).join(s, "campaign_id")

    @cached_property
    def clients(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("client_id"), F.col("c_name").alias("client_name"),
            F.col("c_mktsegment").alias("industry"), F.col("c_acctbal").alias("budget"),
            F.col("c_nationkey").cast("bigint").alias("nation_id"), (F.col("c_custkey") % 11 != 0).alias("is_active"))

    @cached_property
    def client_metrics(self) -> DataFrame:
        o = self.raw("orders").groupBy(F.col("o_custkey").alias("client_id")).agg(
            (F.avg("o_totalprice") / 10).alias("monthly_spend"), F.max(F.col("o_orderdate").cast("date")).alias("last_order"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("tickets"),
            F.count_if(F.col("o_orderstatus") == "P").alias("active"),
            F.count_if(F.col("o_orderstatus") == "O").alias("paused"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
        k = F.col("client_id")
        big = lambda c: c.cast("bigint")
        login = F.datediff(F.lit(AS_OF_ORDERS).cast("date"), "last_order") % 45
        return self.clients.join(o, "client_id", "left").select(
            k, "client_name", "industry", nz("monthly_spend", 0.0).alias("monthly_spend"), F.lit(4.0).alias("target_roas"),
            (F.lit(1.0) + (k % 50) / 10).alias("actual_roas"), (((k % 21) - 10) / 20).alias("roas_trend"),
            big(F.coalesce(login, F.lit(44))).alias("days_since_login"), (k % 40).alias("days_since_contact"),
            nz("tickets").alias("support_tickets_30d"), (k % 4).alias("meetings_30d"),
            nz("active").alias("campaigns_active"), nz("paused").alias("campaigns_paused"),
            (F.lit(0.01) + (k % 30) * 0.001).alias("avg_ctr"), (F.lit(0.005) + (k % 15) * 0.001).alias("avg_cvr"),
            (k % 13).alias("contract_months_remaining"), (k % 3 == 0).alias("is_on_annual"),
            (nz("finished") % 4).alias("payment_delays"))

    @cached_property
    def scored(self) -> DataFrame:
        """Clients with health, churn and a contract end."""
        k = F.col("client_id")
        end = F.date_add(F.lit(AS_OF_ORDERS).cast("date"), ((k * 7) % 400).cast("int"))
        return health.score_clients(self.client_metrics, AS_OF_ORDERS).withColumn("contract_end", end)

    @cached_property
    def alerts(self) -> DataFrame:
        """Error events as alerts, some of them resolved."""
        e, i = self.raw("events").where("event_type = 'error'"), F.col("event_id")
        return e.select(
            i.alias("alert_id"), pick(["critical", "high", "medium", "low"], i % 4).alias("severity"),
            pick(["churn_risk", "roas_drop", "budget_depleted"], i % 3).alias("alert_type"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
            F.when(i % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("resolved_at"), F.when(i % 5 == 0, "resolved").otherwise("open").alias("status"))

    @cached_property
    def client_features(self) -> DataFrame:
        """The second scoring family's columns, from the same metrics."""
        k = F.col("client_id")
        return self.client_metrics.select(
            k, "client_name", "industry", F.col("actual_roas").alias("current_roas"), "target_roas", "roas_trend",
            (k % 9).alias("logins_7d"), (k % 31).alias("logins_30d"), ((k % 10) / 10).alias("meeting_rate"),
            ((k % 60) * 1.0).alias("response_hours"), F.col("days_since_contact").alias("last_contact_days"),
            F.col("support_tickets_30d").alias("tickets_30d"), ((k % 7) / 7).alias("ticket_sentiment"), "monthly_spend",
            (((k % 17) - 8) / 20).alias("revenue_mom_change"), (F.col("payment_delays") * 3.5).alias("payment_delay_days"),
            (k % 3).alias("invoices_outstanding"), F.when(k % 8 != 0, (k * 7) % 365).alias("contract_days_remaining"), (k % 2 == 0).alias("is_month_to_month"), (k % 48).alias("tenure_months"))

    @cached_property
    def interactions(self) -> DataFrame:
        """Orders read as client interactions."""
        k = F.col("o_orderkey")
        kinds = ["email", "call", "meeting", "support_ticket", "dashboard_login", "report_view", "payment"]  # report_view is not an allowed type
        return self.raw("orders").select(
            k.alias("interaction_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("occurred_at"),
            pick(kinds, k % 7).alias("interaction_type"),
            F.when(k % 7 <= 3, (k % 48) * 1.0).alias("response_hours"), F.when(k % 7 == 3, ((k % 21) - 10) / 10).alias("sentiment"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """One health row per client and order day."""
        return self.raw("orders").groupBy(F.col("o_custkey").alias("client_id"), F.col("o_orderdate").cast("date").alias("snapshot_date")).agg(
            F.max("o_orderkey").alias("k")).select(
            "client_id", "snapshot_date", ((F.col("k") * 37) % 101).alias("health_score"), (((F.col("k") * 13) % 100) / 100).alias("churn_probability"))

    @cached_property
    def user_profiles(self) -> DataFrame:
        return audience.user_profiles(self.raw("events"), AS_OF_EVENTS)

    @cached_property
    def creatives(self) -> DataFrame:
        d = F.col("doc_id")
        head = first_sentence(F.col("text"))
        return spread(self.raw("documents")).join(self.raw("labels").select("doc_id", "quality", "toxic"), "doc_id", "left").select(
            d.alias("creative_id"), head.alias("headline"), F.substring(F.col("text"), F.length(head) + 1, F.length("text")).alias("body"),
            pick(PLATFORMS, d % 3).alias("platform"), pick(INDUSTRIES, d % 6).alias("industry"),
            F.when(d % 6 < 5, pick(CTAS, d % 6)).alias("cta"), (d % 50).alias("ad_set_id"), (d % 3 == 0).alias("has_face"),
            F.col("quality").cast("bigint").alias("quality"))

    @cached_property
    def predictions(self) -> DataFrame:
        o = self.raw("orders")
        top = one_row(o.agg(F.max("o_totalprice").alias("m")))
        return o.select((F.col("o_orderkey") % 5).alias("model"), F.col("o_orderkey").alias("id"),
                        (F.col("o_totalprice") / top["m"]).alias("prediction"), F.col("o_orderdate").alias("ts"))

    @cached_property
    def actuals(self) -> DataFrame:
        """Two logged actuals for every third id; the later one wins."""
        p = self.predictions.withColumn("actual", F.col("prediction") + ((F.col("id") % 21) - 10) / 200)
        again = p.where("id % 3 = 0").withColumn("actual", F.col("actual") + 0.01)
        return p.where("id % 11 <> 0").select("model", "id", "actual", F.lit(1).cast("bigint").alias("seq")).unionByName(
            again.select("model", "id", "actual", F.lit(2).cast("bigint").alias("seq")))

    @cached_property
    def ab_outcomes(self) -> DataFrame:
        user = F.col("user_id").cast("string")
        variant = F.when(hash_bucket(F.concat(F.lit("t1:"), user), 10000) / 10000 < 0.5, "control").otherwise("treatment")
        return self.raw("events").select(F.lit("t1").alias("test_id"), "user_id", variant.alias("variant"), F.col("event_type").alias("metric"), "value")

    @cached_property
    def raw_meta(self) -> DataFrame:
        k = F.col("campaign_id")
        return self.campaigns.select(
            F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("m_"), k.cast("string"))).alias("campaign_id"),
            F.concat(F.lit("id_"), k.cast("string")).alias("id"), F.col("campaign_name").alias("name"),
            pick(OBJECTIVES, k % 3).alias("objective"), F.upper("status").alias("status"),
            F.round(F.col("budget") * 100, 0).alias("daily_budget"), ((k % 3) * 50000.0).alias("lifetime_budget"),
            F.lit("2024-01-01").alias("start_time"), F.lit("2024-12-31").alias("stop_time"))

    @cached_property
    def raw_google(self) -> DataFrame:
        k = F.col("campaign_id")
        return self.campaigns.select(
            F.concat(F.lit("g_"), k.cast("string")).alias("campaign_id"), F.col("campaign_name").alias("name"), F.upper("status").alias("status"),
            pick(["SEARCH", "DISPLAY", "VIDEO"], k % 3).alias("advertising_channel_type"),
            F.round("budget", 2).alias("budget_amount"), F.lit("2024-01-01").alias("start_date"), F.lit("2024-12-31").alias("end_date"))

    @cached_property
    def raw_tiktok(self) -> DataFrame:
        k = F.col("campaign_id")
        return self.campaigns.select(
            F.concat(F.lit("t_"), k.cast("string")).alias("campaign_id"), "campaign_name", pick(OBJECTIVES, k % 3).alias("objective_type"),
            F.upper("status").alias("status"), F.round("budget", 2).alias("budget"),
            pick(["BUDGET_MODE_DAY", "BUDGET_MODE_TOTAL", "BUDGET_MODE_INFINITE"], k % 3).alias("budget_mode"))

    @cached_property
    def accounts(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("account_id"), F.col("n_name").alias("name"))

    @cached_property
    def ad_sets(self) -> DataFrame:
        return self.raw("lineitem").select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("ad_set_id"),
                                           F.col("l_suppkey").alias("campaign_id")).distinct()

    @cached_property
    def ads(self) -> DataFrame:
        s = F.col("l_suppkey") * 10 + F.col("l_linenumber")
        return self.raw("lineitem").select((s * 100 + F.col("l_partkey") % 20).alias("ad_id"), s.alias("ad_set_id")).distinct()

    def raw_metrics(self, source: str, daily: DataFrame | None = None) -> DataFrame:
        """Daily rows of the platform's campaigns in its own field names and units; ``daily`` are all platforms' rows, if already at hand."""
        m = (self.ad_metrics if daily is None else daily).where(F.col("campaign_id") % 3 == PLATFORMS.index(source))
        key = ["campaign_id", "day"]
        if source == "meta":
            action = lambda v: F.array(F.struct(F.lit("purchase").alias("action_type"), v.cast("string").alias("value")),
                                       F.struct(F.lit("view").alias("action_type"), F.lit("9").alias("value")))
            none = F.col("conversions") % 2 == 0
            return m.select(*key, "impressions", (F.col("impressions") / 2).cast("bigint").alias("reach"), "clicks", "spend",
                            F.when(~none, action(F.col("conversions"))).alias("actions"), F.when(~none, action(F.col("clicks"))).alias("action_values"),
                            F.lit(0.01).alias("ctr"), F.lit(1.5).alias("cpc"), F.lit(15.0).alias("cpm"))
        if source == "google":
            return m.select(*key, "impressions", "clicks", F.floor(F.col("spend") * 1e6 + 0.5).alias("cost_micros"),
                            (F.col("conversions") * 1.5).alias("conversions"), F.col("revenue").alias("conversions_value"),
                            F.lit(0.01).alias("ctr"), F.lit(1500000).cast("bigint").alias("average_cpc"), F.lit(15000000).cast("bigint").alias("average_cpm"))
        return m.select(*key, "impressions", (F.col("impressions") / 2).cast("bigint").alias("reach"), "clicks", "spend", "conversions",
                        F.lit(0.01).alias("ctr"), F.lit(1.5).alias("cpc"), F.lit(15.0).alias("cpm"))

    @cached_property
    def keywords(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(k.alias("keyword_id"), F.col("p_brand").alias("keyword"), F.col("p_type").alias("search_term"),
                                       pick(["EXACT", "PHRASE", "BROAD"], F.col("p_size") % 3).alias("match_type"), (k % 10 + 1).alias("quality_score"))

    @cached_property
    def keyword_metrics(self) -> DataFrame:
        q = F.col("l_quantity").cast("bigint")
        return self.raw("lineitem").select(F.col("l_partkey").alias("keyword_id"), F.col("l_shipdate").cast("date").alias("day"), (q * 100).alias("impressions"),
                                           q.alias("clicks"), F.lit(1).cast("bigint").alias("conversions"), (F.col("l_extendedprice") * 0.02).alias("spend"))

    @cached_property
    def contacts(self) -> DataFrame:
        u = F.col("user_id")
        return self.raw("events").select("user_id").distinct().select(
            u, F.when(u % 10 == 0, "none").otherwise(F.concat(F.lit(" User"), u.cast("string"), F.lit("@Example.com "))).alias("email"))

    @cached_property
    def webhooks(self) -> DataFrame:
        """Events as webhook payloads of four sources; every 97th one is broken JSON."""
        i = F.col("event_id").cast("string")
        status = F.when(F.col("event_type") == "error", "PAUSED").otherwise("ACTIVE")
        meta = F.format_string('{"object":"campaign","entry":[{"id":"e%s","changes":[{"field":"status","value":{"status":"%s"}}]}]}', i, status)
        google = F.format_string('{"eventType":"%s","n":%s}', F.when(F.col("event_type") == "view", "ACCOUNT_NOTE").otherwise("CAMPAIGN_CHANGE"), i)
        kind = F.when(F.col("event_type") == "purchase", "payment_intent.succeeded").when(
            F.col("event_type") == "error", "payment_intent.payment_failed").when(
            F.col("event_type") == "signup", "customer.subscription.updated").otherwise("charge.created")
        stripe = F.format_string('{"id":"evt_%s","type":"%s"}', i, kind)
        hub = F.format_string('{"subscriptionType":"%s","n":%s}', F.when(F.col("event_type") == "click", "contact.creation").when(
            F.col("event_type") == "view", "deal.propertyChange").otherwise("ticket.change"), i)
        s = F.col("event_id") % 4
        body = F.when(s == 0, meta).when(s == 1, google).when(s == 2, stripe).otherwise(hub)
        return self.raw("events").select(
            "event_id", "ts", pick(["meta", "google", "stripe", "hubspot"], s).alias("source"),
            F.when(F.col("event_id") % 97 == 0, F.lit("{broken")).otherwise(body).alias("payload"))


def _case(values: list[str], idx: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({idx}) + 1]"


def rnd(x: str, digits: int) -> str:
    """SQL rounding on the shortest decimal text of a double, as Spark rounds."""
    return f"round(({x})::double::varchar::decimal(38, 18), {digits})::double"


# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "touchpoints": ("", f"""
select user_id % 5 as client_id, user_id, event_id, ts, channel, event_id % 20 as campaign_id,
  case when channel in ('email','organic') then 0::double else floor(value * 10) / 100 end as cost,
  event_type = 'purchase' as is_conversion, value
from (select *, {_case(CHANNELS, "cast(json_extract_string(props, '$.k') as int) % 5")} as channel from events)"""),
    "journeys": ("touchpoints", """
select *, user_id || ':' || path_no as path_id,
  row_number() over (partition by user_id, path_no order by ts, event_id) as seq,
  lag(channel) over (partition by user_id, path_no order by ts, event_id) as prev_channel,
  lead(channel) over (partition by user_id, path_no order by ts, event_id) as next_channel,
  count(*) over (partition by user_id, path_no) as path_touches
from (select *, coalesce(sum(is_conversion::int) over (partition by user_id order by ts, event_id
        rows between unbounded preceding and 1 preceding), 0)::bigint as path_no from touchpoints)"""),
    "paths": ("journeys", """
select client_id, user_id, path_id, bool_or(is_conversion) as converted,
  sum(case when is_conversion then value else 0 end) as value, count(*) as touchpoints,
  min(ts) as first_touch_at, max(ts) as last_touch_at,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 * 24 as duration_hours
from journeys group by all"""),
    "path_channels": ("journeys paths", """
select j.client_id, j.path_id, j.channel, count(*) as n, sum(j.cost) as cost, any_value(p.converted) as converted,
  any_value(p.value) as value, any_value(p.touchpoints) as path_touches,
  count(*) over (partition by j.client_id, j.path_id) as path_channels,
  bool_or(j.seq = 1) as opens, bool_or(j.seq = j.path_touches) as closes
from journeys j join paths p on j.path_id = p.path_id group by 1, 2, 3"""),
    "edges": ("journeys", """
select *, n / sum(n) over (partition by client_id, from_state) as p from (
  select client_id, from_state, to_state, count(*) as n from (
    select client_id, 'START' as from_state, channel as to_state from journeys where seq = 1
    union all
    select client_id, channel, case when seq = path_touches then case when is_conversion then 'CONVERSION' else 'NULL' end
      else next_channel end from journeys) group by all)"""),
    "ad_metrics": ("", """
select l_suppkey as campaign_id, l_shipdate::date as day, sum(l_quantity::bigint * 100)::bigint as impressions,
  sum(l_quantity::bigint)::bigint as clicks, count(*) as conversions,
  sum(l_extendedprice * (l_tax + 0.02)) as spend, sum(l_extendedprice * l_discount) as revenue
from lineitem group by all"""),
    "campaigns": ("", f"""
select s_suppkey as campaign_id, s_name as campaign_name, {_case(PLATFORMS, 's_suppkey % 3')} as platform, r_name as industry,
  s_nationkey::bigint as account_id, r_regionkey::bigint as client_id, abs(s_acctbal) % 900 + 100 as budget,
  case when s_suppkey % 7 = 0 then 'paused' else 'active' end as status
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "campaign_series": ("ad_metrics", """
select campaign_id, day, rn, spend, revenue, clicks, impressions, conversions, revenue / greatest(spend, 1) as roas
from (select *, row_number() over (partition by campaign_id order by day desc) as rn from ad_metrics)"""),
    "campaign_state": ("campaigns campaign_series", """
select c.campaign_id, campaign_name, platform, account_id, budget as current_budget,
  max(case when rn = 1 then roas end) as roas, max(case when rn = 1 then spend end) as spend_today,
  max(case when rn = 1 then revenue end) as revenue, sum(impressions)::bigint as impressions,
  sum(clicks)::bigint as clicks, sum(conversions)::bigint as conversions
from campaigns c join campaign_series s on c.campaign_id = s.campaign_id group by 1, 2, 3, 4, 5"""),
    "clients": ("", """
select c_custkey as client_id, c_name as client_name, c_mktsegment as industry, c_acctbal as budget,
  c_nationkey::bigint as nation_id, c_custkey % 11 <> 0 as is_active from customer"""),
    "client_metrics": ("clients", f"""
select client_id, client_name, industry, coalesce(ms, 0)::double as monthly_spend, 4::double as target_roas,
  1 + (client_id % 50) / 10::double as actual_roas, ((client_id % 21) - 10) / 20::double as roas_trend,
  coalesce(datediff('day', last_order, date '{AS_OF_ORDERS}') % 45, 44)::bigint as days_since_login,
  client_id % 40 as days_since_contact, coalesce(tickets, 0) as support_tickets_30d, client_id % 4 as meetings_30d,
  coalesce(active, 0) as campaigns_active, coalesce(paused, 0) as campaigns_paused,
  0.01::double + (client_id % 30) * 0.001::double as avg_ctr, 0.005::double + (client_id % 15) * 0.001::double as avg_cvr,
  client_id % 13 as contract_months_remaining, client_id % 3 = 0 as is_on_annual, coalesce(finished, 0) % 4 as payment_delays
from clients left join (select o_custkey, avg(o_totalprice) / 10 as ms, max(o_orderdate::date) as last_order,
    count(*) filter (o_orderpriority = '1-URGENT') as tickets, count(*) filter (o_orderstatus = 'P') as active,
    count(*) filter (o_orderstatus = 'O') as paused, count(*) filter (o_orderstatus = 'F') as finished
  from orders group by 1) on client_id = o_custkey"""),
    "health": ("client_metrics", f"""
select *, {rnd('o', 1)} as overall_score, {rnd('s1', 1)} as roas_score, {rnd('s2', 1)} as engagement_score, {rnd('s3', 1)} as payment_score,
  {rnd('s4', 1)} as communication_score, {rnd('s5', 1)} as growth_score
from (select *, s1 * 0.3::double + s2 * 0.25::double + s3 * 0.15::double + s4 * 0.15::double + s5 * 0.15::double as o from (
  select *, greatest(0, least(100, actual_roas / greatest(target_roas, 0.1) * 50 + roas_trend * 20)) as s1,
    (greatest(0, 100 - days_since_login * 5) + greatest(0, 100 - days_since_contact * 3)) / 2::double as s2,
    (100 - least(100, payment_delays * 25))::double as s3,
    greatest(0, least(100, meetings_30d * 25) - least(50, support_tickets_30d * 10) + 25)::double as s4,
    least(100, campaigns_active / greatest(campaigns_active + campaigns_paused, 1)::double * 50 + (avg_ctr / 0.02 + avg_cvr / 0.01) * 25) as s5
  from client_metrics))"""),
    "factors": ("client_metrics", """
select client_id, i, factor, severity, impact::double as impact, description, trend, row_number() over (partition by client_id order by impact desc, i) as pos from (
  select client_id, 1 as i, 'ROAS Below Target' as factor, case when actual_roas < target_roas * 0.5 then 'high' else 'medium' end as severity, 0.25 as impact,
    printf('Current ROAS (%.2f) is %.0f%% below target', actual_roas, (1 - actual_roas / target_roas) * 100) as description,
    case when roas_trend < 0 then 'declining' when roas_trend > 0 then 'improving' else 'stable' end as trend from client_metrics where actual_roas < target_roas * 0.8
  union all select client_id, 2, 'Low Platform Engagement', case when days_since_login > 30 then 'high' else 'medium' end, 0.20,
    printf('No login for %d days', days_since_login), 'declining' from client_metrics where days_since_login > 14
  union all select client_id, 3, 'Support Escalations', case when support_tickets_30d > 5 then 'high' else 'medium' end, 0.15,
    printf('%d support tickets in last 30 days', support_tickets_30d), 'stable' from client_metrics where support_tickets_30d > 3
  union all select client_id, 4, 'Payment Delays', case when payment_delays > 2 then 'high' when payment_delays > 1 then 'medium' else 'low' end, 0.15,
    printf('%d payment delay(s) recorded', payment_delays), 'stable' from client_metrics where payment_delays > 0
  union all select client_id, 5, 'Contract Ending Soon', case when contract_months_remaining < 1 then 'high' else 'medium' end, 0.10,
    printf('Contract ends in %d months', contract_months_remaining), 'stable' from client_metrics where contract_months_remaining < 3 and not is_on_annual
  union all select client_id, 6, 'High Campaign Pause Rate', 'medium', 0.10, printf('%d/%d campaigns paused', campaigns_paused, campaigns_active + campaigns_paused), 'stable'
    from client_metrics where campaigns_active + campaigns_paused > 0 and campaigns_paused / (campaigns_active + campaigns_paused)::double > 0.5
  union all select client_id, 7, 'Lack of Communication', 'medium', 0.10, printf('No contact for %d days, 0 meetings this month', days_since_contact), 'declining'
    from client_metrics where days_since_contact > 21 and meetings_30d = 0)"""),
    "scored": ("health factors", f"""
select *, {rnd('p', 3)} as churn_probability, date '{AS_OF_ORDERS}' + days_to_churn as predicted_churn_date,
  date '{AS_OF_ORDERS}' + ((client_id * 7) % 400)::int as contract_end from (
  select *, case when p >= 0.75 then 'critical' when p >= 0.5 then 'warning' when p >= 0.25 then 'monitor' else 'healthy' end as risk_level,
    case when p >= 0.75 then 30 when p >= 0.5 then 60 when p >= 0.25 then 90 end as days_to_churn from (
    select h.*, n_factors, greatest(0.05, least(0.95, greatest(0, (100 - overall_score) / 100) * 0.6::double
      + coalesce(imp, 0) * case when is_on_annual then 0.7 else 1 end * case when actual_roas > target_roas * 1.2 then 0.6 else 1 end * 0.4::double)) as p
    from health h left join (select client_id, sum(impact) as imp, count(*) as n_factors from factors group by 1) f on f.client_id = h.client_id))"""),
    "alerts": ("", """
select event_id as alert_id, (['critical','high','medium','low'])[event_id % 4 + 1] as severity,
  (['churn_risk','roas_drop','budget_depleted'])[event_id % 3 + 1] as alert_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as created_at,
  case when event_id % 5 = 0 then strftime(ts, '%Y-%m-%d') end as resolved_at, case when event_id % 5 = 0 then 'resolved' else 'open' end as status
from events where event_type = 'error'"""),
    "client_features": ("client_metrics", """
select client_id, client_name, industry, actual_roas as current_roas, target_roas, roas_trend,
  client_id % 9 as logins_7d, client_id % 31 as logins_30d, (client_id % 10) / 10::double as meeting_rate,
  (client_id % 60)::double as response_hours, days_since_contact as last_contact_days, support_tickets_30d as tickets_30d,
  (client_id % 7) / 7::double as ticket_sentiment, monthly_spend, ((client_id % 17) - 8) / 20::double as revenue_mom_change,
  payment_delays * 3.5::double as payment_delay_days, client_id % 3 as invoices_outstanding, case when client_id % 8 <> 0 then (client_id * 7) % 365 end as contract_days_remaining,
  client_id % 2 = 0 as is_month_to_month, client_id % 48 as tenure_months from client_metrics"""),
    "interactions": ("", """
select o_orderkey as interaction_id, o_custkey as client_id, o_orderdate as occurred_at,
  (['email','call','meeting','support_ticket','dashboard_login','report_view','payment'])[o_orderkey % 7 + 1] as interaction_type,
  case when o_orderkey % 7 <= 3 then (o_orderkey % 48)::double end as response_hours,
  case when o_orderkey % 7 = 3 then ((o_orderkey % 21) - 10) / 10::double end as sentiment from orders"""),
    "snapshots": ("", """
select client_id, snapshot_date, (k * 37) % 101 as health_score, ((k * 13) % 100) / 100::double as churn_probability
from (select o_custkey as client_id, o_orderdate::date as snapshot_date, max(o_orderkey) as k from orders group by 1, 2)"""),
    "event_gaps": ("", """
select *, lag(ts) over w as prev_ts, lead(ts) over w as next_ts from events window w as (partition by user_id order by ts, event_id)"""),
    "user_profiles": ("event_gaps", f"""
select user_id, sessions_30d, pageviews_30d, time_s / 60 / greatest(sessions_30d, 1) as time_on_site_avg,
  bounces / greatest(sessions_30d, 1)::double as bounce_rate, purchases_30d, total_revenue_30d,
  total_revenue_30d / greatest(purchases_30d, 1) as avg_order_value, email_opens_30d, ad_clicks_30d,
  days_since_last_visit, days_since_last_purchase from (
  select user_id,
    count(*) filter (prev_ts is null or epoch_us(ts) - epoch_us(prev_ts) > 1800000000) as sessions_30d,
    count(*) filter (event_type = 'view') as pageviews_30d,
    sum(case when epoch_us(ts) - epoch_us(prev_ts) <= 1800000000 then (epoch_us(ts) - epoch_us(prev_ts)) / 1e6 else 0 end)::double as time_s,
    count(*) filter ((prev_ts is null or epoch_us(ts) - epoch_us(prev_ts) > 1800000000)
      and (next_ts is null or epoch_us(next_ts) - epoch_us(ts) > 1800000000)) as bounces,
    count(*) filter (event_type = 'purchase') as purchases_30d,
    sum(case when event_type = 'purchase' then value else 0 end)::double as total_revenue_30d,
    count(*) filter (event_type = 'signup') as email_opens_30d, count(*) filter (event_type = 'click') as ad_clicks_30d,
    datediff('day', max(ts)::date, date '{AS_OF_EVENTS}') as days_since_last_visit,
    coalesce(datediff('day', max(case when event_type = 'purchase' then ts end)::date, date '{AS_OF_EVENTS}'), 90) as days_since_last_purchase
  from event_gaps where ts >= timestamp '{AS_OF_EVENTS}' - interval 30 day and ts < timestamp '{AS_OF_EVENTS}' group by 1)"""),
    "creatives": ("", f"""
select creative_id, headline, substr(text, length(headline) + 1) as body, platform, industry, cta, ad_set_id, has_face, quality from (
  select d.doc_id as creative_id, text, regexp_extract(text, '^[^.!?\\n]*[.!?]?') as headline,
    {_case(PLATFORMS, 'd.doc_id % 3')} as platform, {_case(INDUSTRIES, 'd.doc_id % 6')} as industry,
    case when d.doc_id % 6 < 5 then {_case(CTAS, 'd.doc_id % 6')} end as cta, d.doc_id % 50 as ad_set_id,
    d.doc_id % 3 = 0 as has_face, quality::bigint as quality
  from documents d left join labels l on d.doc_id = l.doc_id)"""),
    "predictions": ("", """
select o_orderkey % 5 as model, o_orderkey as id, o_totalprice / (select max(o_totalprice) from orders) as prediction, o_orderdate as ts from orders"""),
    "actuals": ("predictions", """
select model, id, prediction + ((id % 21) - 10) / 200::double as actual, 1 as seq from predictions where id % 11 <> 0
union all
select model, id, prediction + ((id % 21) - 10) / 200::double + 0.01::double, 2 from predictions where id % 3 = 0"""),
    "ab_outcomes": ("", """
select 't1' as test_id, user_id, case when (('0x' || substr(md5('t1:' || user_id), 1, 8))::bigint % 10000) / 10000 < 0.5
  then 'control' else 'treatment' end as variant, event_type as metric, value from events"""),
    "raw_meta": ("campaigns", f"""
select case when campaign_id % 4 = 0 then '' when campaign_id % 4 = 1 then null else 'm_' || campaign_id end as campaign_id,
  'id_' || campaign_id as id, campaign_name as name, {_case(OBJECTIVES, 'campaign_id % 3')} as objective, upper(status) as status,
  round(budget * 100, 0) as daily_budget, ((campaign_id % 3) * 50000)::double as lifetime_budget,
  '2024-01-01' as start_time, '2024-12-31' as stop_time from campaigns"""),
    "raw_google": ("campaigns", f"""
select 'g_' || campaign_id as campaign_id, campaign_name as name, upper(status) as status,
  {_case(['SEARCH', 'DISPLAY', 'VIDEO'], 'campaign_id % 3')} as advertising_channel_type, round(budget, 2) as budget_amount,
  '2024-01-01' as start_date, '2024-12-31' as end_date from campaigns"""),
    "raw_tiktok": ("campaigns", f"""
select 't_' || campaign_id as campaign_id, campaign_name, {_case(OBJECTIVES, 'campaign_id % 3')} as objective_type, upper(status) as status,
  round(budget, 2) as budget, {_case(['BUDGET_MODE_DAY', 'BUDGET_MODE_TOTAL', 'BUDGET_MODE_INFINITE'], 'campaign_id % 3')} as budget_mode from campaigns"""),
    "ad_sets": ("", "select distinct l_suppkey * 10 + l_linenumber as ad_set_id, l_suppkey as campaign_id from lineitem"),
    "ads": ("", "select distinct (l_suppkey * 10 + l_linenumber) * 100 + l_partkey % 20 as ad_id, l_suppkey * 10 + l_linenumber as ad_set_id from lineitem"),
    "keywords": ("", """
select p_partkey as keyword_id, p_brand as keyword, p_type as search_term, (['EXACT','PHRASE','BROAD'])[p_size % 3 + 1] as match_type,
  p_partkey % 10 + 1 as quality_score from part"""),
    "contacts": ("", """
select distinct user_id, case when user_id % 10 = 0 then 'none' else ' User' || user_id || '@Example.com ' end as email from events"""),
    "norm_campaigns": ("raw_meta raw_google raw_tiktok", """
select coalesce(nullif(campaign_id, ''), id) as external_id, 'meta' as platform, name, lower(status) as status, objective,
  daily_budget / 100 as daily_budget, case when lifetime_budget <> 0 then lifetime_budget / 100 end as lifetime_budget,
  start_time as start_date, stop_time as end_date from raw_meta
union all select campaign_id, 'google', name, lower(status), advertising_channel_type, budget_amount, null, start_date, end_date from raw_google
union all select campaign_id, 'tiktok', campaign_name, lower(status), objective_type, case when budget_mode = 'BUDGET_MODE_DAY' then budget end,
  case when budget_mode = 'BUDGET_MODE_TOTAL' then budget end, null, null from raw_tiktok"""),
    "norm_metrics": ("ad_metrics", """
select campaign_id, day, 'meta' as platform, impressions, impressions // 2 as reach, clicks, spend,
  case when conversions % 2 = 0 then 0 else conversions end::double as conversions, case when conversions % 2 = 0 then 0 else clicks end::double as conversion_value,
  0.01::double as ctr, 1.5::double as cpc, 15::double as cpm from ad_metrics where campaign_id % 3 = 0
union all select campaign_id, day, 'google', impressions, 0, clicks, floor(spend * 1e6 + 0.5) / 1e6, conversions * 1.5::double, revenue,
  0.01::double, 1.5::double, 15::double from ad_metrics where campaign_id % 3 = 1
union all select campaign_id, day, 'tiktok', impressions, impressions // 2, clicks, spend, conversions::double, 0::double,
  0.01::double, 1.5::double, 15::double from ad_metrics where campaign_id % 3 = 2"""),
    "webhooks": ("", """
select event_id, ts, source, case when event_id % 97 = 0 then '{broken' else body end as payload from (
  select event_id, ts, (['meta','google','stripe','hubspot'])[event_id % 4 + 1] as source,
    case event_id % 4
      when 0 then '{"object":"campaign","entry":[{"id":"e' || event_id || '","changes":[{"field":"status","value":{"status":"'
        || case when event_type = 'error' then 'PAUSED' else 'ACTIVE' end || '"}}]}]}'
      when 1 then '{"eventType":"' || case when event_type = 'view' then 'ACCOUNT_NOTE' else 'CAMPAIGN_CHANGE' end || '","n":' || event_id || '}'
      when 2 then '{"id":"evt_' || event_id || '","type":"' || case event_type when 'purchase' then 'payment_intent.succeeded'
        when 'error' then 'payment_intent.payment_failed' when 'signup' then 'customer.subscription.updated' else 'charge.created' end || '"}'
      else '{"subscriptionType":"' || case event_type when 'click' then 'contact.creation' when 'view' then 'deal.propertyChange'
        else 'ticket.change' end || '","n":' || event_id || '}' end as body from events)"""),
}


def with_views(names: list[str], sql: str) -> str:
    """Prefix the needed views, dependencies first, as CTEs."""
    order: list[str] = []

    def need(n: str) -> None:
        deps, _ = VIEWS[n]
        for d in deps.split():
            need(d)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"
