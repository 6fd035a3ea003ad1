"""Registered queries: the given events table read as a stream and run to its end."""

from pyspark.sql import functions as F

from spendlens.operators import alerts as L

from spendlens.plans.catalog_scoring import TRIG, contexts
from spendlens.plans.registry import query
from spendlens.plans.views import Tables
from spendlens.session import shared_scratch
from spendlens.streaming import stateful as S
from spendlens.streaming import webhooks as H
from spendlens.streaming import windows as W

c = F.col


class StreamTables(Tables):
    """The same views over tables read as streams; names in static stay batch tables."""

    def __init__(self, spark, sf_dir, static=("supplier", "nation", "region")):
        super().__init__(spark, sf_dir)
        self.static = static

    def raw(self, name):
        if name in self.static:
            return super().raw(name)
        return W.stream_table(self.spark, self.sf_dir, name)


def streams(t):
    return StreamTables(t.spark, t.sf_dir)


TYPE_SQL = """case source
  when 'meta' then case when payload like '%"status":"PAUSED"%' then 'campaign.paused' else 'campaign.updated' end
  when 'google' then case when payload like '%CAMPAIGN%' then 'campaign.updated' end
  when 'stripe' then case when payload like '%payment_intent.succeeded%' then 'payment.succeeded' when payload like '%payment_failed%' then 'payment.failed'
    when payload like '%subscription.updated%' then 'subscription.updated' end
  else case when payload like '%contact%' then 'contact.updated' when payload like '%deal%' then 'deal.updated' end end"""
PARSED = f"""select event_id, source, payload <> '{{broken' as is_json, case when payload <> '{{broken' then {TYPE_SQL} end as event_type,
  case when payload = '{{broken' then null when source = 'meta' then 'e' || event_id when source = 'stripe' then 'evt_' || event_id when source = 'google' then md5(payload)
    else md5('{{"n":' || event_id || ',"subscriptionType":"' || json_extract_string(case when payload <> '{{broken' then payload else '{{}}' end, '$.subscriptionType') || '"}}') end as event_key from webhooks"""
HANDLED = "('campaign.updated', 'campaign.paused', 'payment.failed')"


@query("x01_parse_events", "webhooks", PARSED)
def _(t):
    return W.collect_append(H.parse_events(streams(t).webhooks), "parsed").select("event_id", "source", "is_json", "event_type", "event_key")


SECRETS = {"meta": "m-secret", "google": "g-secret", "stripe": "s-secret"}


def signed(df):
    """Webhooks with a signature made from the same secrets; every tenth one is forged."""
    stamped = df.withColumn("sent_at", c("event_id").cast("string"))
    own = F.when(c("source") == "meta", F.concat(F.lit("sha256="), H.expected_signature("meta", SECRETS["meta"]))).when(
        c("source") == "google", H.expected_signature("google", SECRETS["google"])).when(
        c("source") == "stripe", F.concat(F.lit("t="), c("sent_at"), F.lit(",v1="), H.expected_signature("stripe", SECRETS["stripe"]))).otherwise("")
    return stamped.withColumn("signature", F.when(c("event_id") % 10 == 0, F.reverse(own)).otherwise(own))


@query("x02_verify_signatures", "webhooks", "select event_id, source = 'hubspot' or event_id % 10 <> 0 as is_authentic from webhooks")
def _(t):
    return W.collect_append(H.verify_signatures(signed(streams(t).webhooks), SECRETS).select("event_id", "is_authentic"), "verified")


def repeated(df):
    """Every third webhook is delivered twice."""
    return df.withColumn("copy", F.explode(F.when(c("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))


def timed(df):
    return df.withColumn("ts", c("ts").cast("timestamp"))


@query("x03_dedupe_events", "webhooks", f"select distinct source, event_key, event_type from ({PARSED}) where event_type in {HANDLED}")
def _(t):
    raw = repeated(timed(streams(t).webhooks))
    return W.collect_append(H.dedupe_events(H.parse_events(raw)).select("source", "event_key", "event_type"), "unique")


@query("x04_route", "webhooks", f"select event_type, count(*) as events from ({PARSED}) where event_type is not null group by 1")
def _(t):
    router = H.Router(shared_scratch(t.spark, "routed"))
    paused = shared_scratch(t.spark, "paused")
    router.register("campaign.paused", lambda df: df.write.mode("append").parquet(paused))
    W.run_batches(H.parse_events(streams(t).webhooks).where("event_type is not null"), router, shared_scratch(t.spark, "routed-ckpt"))
    return t.spark.read.parquet(router.path).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("x05_dead_letter", "webhooks", "select source, count(*) as letters, 3 as attempts from webhooks where payload = '{broken' group by 1")
def _(t):
    letters = W.collect_append(H.dead_letters(H.parse_events(streams(t).webhooks)), "dead")
    for _ in range(H.MAX_ATTEMPTS - 1):
        _, letters = H.retry(letters)
    return letters.groupBy("source", "attempts").agg(F.count(F.lit(1)).alias("letters"))


@query("x06_incremental_sync", "touchpoints", "select client_id, count(*) as touches, sum(cost) as cost from touchpoints group by 1", r="cost", digits=2)
def _(t):
    # two landings, one job run after each: the checkpoint makes the second run read only the new files
    landing, out, ckpt = (shared_scratch(t.spark, n) for n in ("landing", "synced", "synced-ckpt"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        t.touchpoints.where(part).write.mode("append").parquet(landing)
        W.run_append(t.spark.readStream.schema(t.touchpoints.schema).parquet(landing), out, ckpt)
    return t.spark.read.parquet(out).groupBy("client_id").agg(F.count(F.lit(1)).alias("touches"), F.sum("cost").alias("cost"))


def metric_events(tables):
    one = F.lit(1).cast("bigint")
    return tables.touchpoints.select(
        "ts", "campaign_id", c("cost").alias("spend"), F.when(c("is_conversion"), c("value")).otherwise(0.0).alias("revenue"),
        one.alias("clicks"), one.alias("impressions"), c("is_conversion").cast("bigint").alias("conversions"))


METRICS = "select ts, campaign_id, cost as spend, case when is_conversion then value else 0 end as revenue, 1 as clicks, 1 as impressions, is_conversion::int as conversions from touchpoints"
SUMS = "sum(spend) as spend, sum(revenue) as revenue, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions, sum(conversions)::bigint as conversions"
FMT = "yyyy-MM-dd HH:mm"


def texts(df, *names):
    return df.withColumns({n: F.date_format(n, FMT) for n in names})


@query("x07_metrics_tumbling", "touchpoints", f"""
select strftime(w, '%Y-%m-%d %H:%M') as window_start, strftime(w + interval 30 minute, '%Y-%m-%d %H:%M') as window_end, campaign_id, {SUMS}
from (select *, time_bucket(interval 30 minute, ts) as w from ({METRICS})) group by w, campaign_id""", r="spend revenue")
def _(t):
    out = W.collect_update(W.metrics_tumbling(metric_events(streams(t)), "campaign_id"), "tumbling", ["window_start", "campaign_id"])
    return texts(out, "window_start", "window_end")


@query("x08_metrics_sliding", "touchpoints", f"""
with s as (select time_bucket(interval 30 minute, ts) as b, campaign_id, {SUMS} from ({METRICS}) group by 1, 2),
  w as (select b - i * interval 30 minute as ws, campaign_id, spend, revenue, clicks, impressions, conversions from s, range(0, 48) r(i))
select strftime(ws, '%Y-%m-%d %H:%M') as window_start, strftime(ws + interval 24 hour, '%Y-%m-%d %H:%M') as window_end, campaign_id, {SUMS} from w
group by ws, campaign_id""", r="spend revenue", digits=3)
def _(t):
    out = W.collect_append(W.metrics_sliding(metric_events(released(t)), "campaign_id"), "sliding")
    return texts(out, "window_start", "window_end")


@query("x09_session_stream", "event_gaps", """
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M') as session_start, strftime(max(ts) + interval 30 minute, '%Y-%m-%d %H:%M') as session_end, count(*) as events from (
  select *, sum(case when prev_ts is null or epoch_us(ts) - epoch_us(prev_ts) >= 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as n from event_gaps)
group by user_id, n""")
def _(t):
    return texts(W.collect_append(W.session_stream(released(t).raw("events")), "sessions"), "session_start", "session_end")


@query("x10_late_data", "touchpoints", f"""
with m as (select *, event_id % 10 = 0 as late from (select t.event_id, x.* from touchpoints t join ({METRICS}) x on x.ts = t.ts and x.campaign_id = t.campaign_id)),
  w as (select time_bucket(interval 30 minute, ts) as b, * from m)
select strftime(b, '%Y-%m-%d %H:%M') as window_start, campaign_id, sum(clicks)::bigint as clicks from w
where b + interval 30 minute <= (select max(ts) - interval 1 hour from m)
  and (not late or b + interval 30 minute > (select max(ts) - interval 1 hour from m where not late)) group by b, campaign_id""")
def _(t):
    # on-time rows land first; each tenth row lands when the watermark has long passed it
    landing, out, ckpt = (shared_scratch(t.spark, n) for n in ("landing", "windows", "windows-ckpt"))
    for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        rows = t.touchpoints.where(part)
        rows.write.mode("append").parquet(landing)
        tables = StreamTables(t.spark, t.sf_dir)
        tables.touchpoints = t.spark.readStream.schema(t.touchpoints.schema).parquet(landing)
        W.run_append(W.metrics_tumbling(metric_events(tables), "campaign_id"), out, ckpt)
    return texts(t.spark.read.parquet(out), "window_start").select("window_start", "campaign_id", "clicks")


@query("x11_enrich_stream", "touchpoints campaigns", "select event_id, campaign_id, campaign_name, platform from touchpoints left join campaigns using (campaign_id)")
def _(t):
    s = streams(t)
    return W.collect_append(W.enrich_stream(s.touchpoints, s.campaigns).select("event_id", "campaign_id", "campaign_name", "platform"), "enriched")


@query("x12_prediction_actual_stream", "", """
with p as (select o_orderkey % 5 as model, o_orderkey as id, o_totalprice / 500000 as prediction, o_orderdate as ts from orders),
  j as (select model, prediction, prediction + ((id % 21) - 10) / 200::double as actual from p where id % 12 <= 7)
select model, avg(abs(prediction - actual)) as mae, sqrt(avg((prediction - actual) ** 2)) as rmse, count(*) as samples from j group by 1""", r="mae rmse", digits=6)
def _(t):
    k = c("o_orderkey")
    price = c("o_totalprice") / 500000
    o = streams(t).raw("orders")
    p = o.select((k % 5).alias("model"), k.alias("id"), price.alias("prediction"), c("o_orderdate").alias("ts"))
    a = o.select((k % 5).alias("model"), k.alias("id"), (price + ((k % 21) - 10) / 200).alias("actual"),
                 (c("o_orderdate") + F.make_dt_interval((k % 12).cast("int"))).alias("ts"))
    joined = W.collect_append(W.prediction_actual_stream(p, a), "matched")
    d = c("prediction") - c("actual")
    return joined.groupBy("model").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count(F.lit(1)).alias("samples"))


def released(t, sentinel_days=40):
    """The events stream and one far later row per key that pushes the watermark past all others."""
    landing = shared_scratch(t.spark, "landing")
    ev = t.raw("events")
    late = ev.groupBy("user_id", "event_type").agg(F.max("value").alias("value"), F.max("props").alias("props"), F.max("event_id").alias("event_id"))
    last = late.select((-c("event_id") - 1).alias("event_id"), F.lit("2024-04-01").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", F.lit(-1.0).alias("value"), "props")
    ev.write.parquet(landing)
    last.select(*ev.columns).write.mode("append").parquet(landing)
    tables = StreamTables(t.spark, t.sf_dir)
    stream = t.spark.readStream.schema(ev.schema).parquet(landing)
    tables.raw = lambda name: stream
    return tables


def fired_sql(trig):
    return f"""with recursive trig as materialized ({trig}),
  f as (select rule_id, user_id, min(ts) as ts, max(cooldown_minutes) as m from trig group by 1, 2
    union all select * from (select f.rule_id, f.user_id, (select min(x.ts) from trig x where x.rule_id = f.rule_id and x.user_id = f.user_id and x.ts >= f.ts + f.m * interval 1 minute) as ts, f.m from f) where ts is not null)
select t.rule_id, t.user_id, min(t.event_id) as event_id from trig t join f on t.rule_id = f.rule_id and t.user_id = f.user_id and t.ts = f.ts group by t.rule_id, t.user_id, t.ts"""


@query("x13_alert_stream", "", fired_sql(TRIG))
def _(t):
    stream = L.evaluate_rules(contexts(released(t)))
    return W.collect_append(S.alert_stream(stream, ["rule_id", "user_id"]), "alerts", S.STORE).where("event_id >= 0")


@query("x14_changes_stream", "", """
select user_id, event_id from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) where event_type is distinct from prev""")
def _(t):
    rows = released(t).raw("events")
    return W.collect_append(S.changes_stream(rows, "user_id", ["user_id", "event_type"]), "changes", S.STORE).where("event_id >= 0").select("user_id", "event_id")


@query("s12_read_event_bus", "webhooks", "select source, count(*) as events from webhooks group by 1")
def _(t):
    # the file form of the event bus; the bus itself is spendlens.sources.landed.read_event_bus
    from spendlens.sources.landed import read_event_files
    landing = shared_scratch(t.spark, "bus")
    t.webhooks.select("source", "payload", "ts").write.json(landing)
    got = W.collect_append(read_event_files(t.spark, "source string, payload string, ts timestamp", landing, 1), "bus-out")
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("events"))
