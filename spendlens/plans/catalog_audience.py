"""Registered queries: audiences and set operations."""

from pyspark.sql import functions as F

from spendlens.functions.spatial import dbscan, min_max_scaled
from spendlens.operators import aggregates as A
from spendlens.operators import attribution as T
from spendlens.operators import audience as U
from spendlens.operators import setops as Z
from spendlens.plans.catalog_ingest import norm_campaigns
from spendlens.plans.registry import query
from spendlens.plans.views import rnd
from spendlens.session import staged

PROFILE = "user_id sessions_30d pageviews_30d time_on_site_avg bounce_rate purchases_30d total_revenue_30d avg_order_value email_opens_30d ad_clicks_30d days_since_last_visit days_since_last_purchase"


@query("u01_user_profiles", "user_profiles", f"select {PROFILE.replace(' ', ', ')} from user_profiles", r="time_on_site_avg bounce_rate total_revenue_30d avg_order_value")
def _(t):
    return t.user_profiles


US = """select *, least(100, least(30, sessions_30d * 3) + least(20, email_opens_30d * 2) + least(25, time_on_site_avg * 5) + greatest(0, 25 - bounce_rate * 25))::double as engagement_score,
  least(100, least(40, total_revenue_30d / 10) + least(30, purchases_30d * 10) + least(30, avg_order_value / 5))::double as value_score,
  least(100, greatest(0, 50 - days_since_last_visit * 2) + greatest(0, 50 - days_since_last_purchase))::double as recency_score from user_profiles"""


def scored(t):
    return U.score_users(t.user_profiles)


for _n, _c in {"u02_engagement_score": "engagement_score", "u03_value_score": "value_score", "u04_recency_score": "recency_score"}.items():
    @query(_n, "user_profiles", f"select user_id, {_c} from ({US})", r=_c)
    def _(t, c=_c):
        return scored(t).select("user_id", c)


@query("u05_feature_vector", "user_profiles", f"select user_id, p::bigint as pos, v as value from (select user_id, unnest(f) as v, generate_subscripts(f, 1) - 1 as p from (select user_id, [{', '.join(c + '::double' for c in U.FEATURES)}] as f from ({US})))", r="value")
def _(t):
    from pyspark.ml.functions import vector_to_array
    v = U.feature_vector(scored(t)).select("user_id", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    return v.select("user_id", F.col("pos").cast("bigint").alias("pos"), "value")


# what can be said of clusters without their seeds: the nearest centre, centres that are means, every row in one
@query("u06_kmeans_segments", "user_profiles", "select user_id, true as nearest, true as centre_is_mean, count(*) over () as rows_in_clusters from user_profiles")
def _(t):
    s = staged(scored(t), "scored")
    model = U.kmeans_standardised(s)
    return U.assignment_facts(U.assign(s, model), model)


@query("u07_kmeans_minmax", "user_profiles", "select user_id, true as nearest, true as centre_is_mean, count(*) over () as rows_in_clusters from user_profiles")
def _(t):
    s = staged(scored(t), "scored")
    model = U.kmeans_minmax(s)
    return U.assignment_facts(U.assign(s, model), model)


DIMS = ["sessions_30d", "total_revenue_30d", "engagement_score", "recency_score"]


def scaled_sql(dims):
    return ", ".join(f"({d} - min({d}) over ()) / greatest(max({d}) over () - min({d}) over (), 1e-10)::double as {d}" for d in dims)


def dist_sql(dims):
    return " + ".join(f"(a.{d} - b.{d}) ** 2" for d in dims)


def dbscan_sql(dims, eps, k, src):
    return f"""with recursive pts as materialized (select user_id, {scaled_sql(dims)} from ({src})),
  near as materialized (select a.user_id as u, b.user_id as v from pts a join pts b on {dist_sql(dims)} <= {eps}::double * {eps}::double),
  core as materialized (select u from near group by u having count(*) >= {k}),
  link as materialized (select u, v from near where u in (select u from core) and v in (select u from core)),
  reach as (select u, u as r from core union select l.v, r.r from reach r join link l on l.u = r.u),
  comp as (select u, min(r) as c from reach group by u),
  ids as (select c, row_number() over (order by c) - 1 as label from (select distinct c from comp)),
  lab as (select u, label from comp join ids using (c))
select p.user_id, coalesce(any_value(l.label), min(b.label), -1) as label, count(distinct n.v) as neighbours from pts p join near n on n.u = p.user_id
left join lab l on l.u = p.user_id left join lab b on b.u = n.v group by 1"""


@query("u08_dbscan_default", "user_profiles", dbscan_sql(U.FEATURES, 0.5, 5, US))
def _(t):
    return dbscan(min_max_scaled(scored(t), "user_id", U.FEATURES), "user_id", U.FEATURES)


@query("u08_dbscan_tight", "user_profiles", dbscan_sql(DIMS, 0.12, 4, US))
def _(t):
    return dbscan(min_max_scaled(scored(t), "user_id", DIMS), "user_id", DIMS, 0.12, 4)


@query("u09_assign_member", "user_profiles", "select user_id, true as nearest, count(*) over () as rows_in_clusters from user_profiles where user_id % 2 = 1")
def _(t):
    s = staged(scored(t), "scored")
    model = U.kmeans_standardised(s.where("user_id % 2 = 0"))
    return U.assignment_facts(U.assign(s.where("user_id % 2 = 1"), model), model).drop("centre_is_mean")


FIXED = f"select *, user_id % 4 as cluster from ({US})"


def fixed_clusters(t):
    return scored(t).withColumn("cluster", F.col("user_id") % 4)


RAW_SEG = f"""select cluster, count(*) as size, avg(sessions_30d) as s, avg(total_revenue_30d) as rev, avg(engagement_score) as e, avg(email_opens_30d) as opens, avg(ad_clicks_30d) as clicks,
  5 - least(4, avg(days_since_last_visit) / 7) as r, least(5, avg(sessions_30d) / 5 + 1) as f, least(5, avg(total_revenue_30d) / 100 + 1) as m from ({FIXED}) group by 1"""
NAME = """case when r >= 4 and f >= 4 and m >= 4 then 'Champions' when r >= 3 and f >= 4 then 'Loyal Customers' when r >= 3 and f >= 2 and m >= 2 then 'Potential Loyals'
  when r >= 4 and f <= 2 then 'New Customers' when r >= 3 and f <= 2 and m <= 2 then 'Promising' when r between 2 and 3 and f >= 2 and m >= 2 then 'Need Attention'
  when r <= 2 and f >= 2 then 'About to Sleep' when r <= 2 and f <= 2 then 'Hibernating' else 'General Audience' end"""
TRAITS = """array_to_string(list_filter([case when r >= 4 then 'Recently active' when r <= 2 then 'Inactive/dormant' end, case when f >= 4 then 'Frequent visitors' when f <= 2 then 'Infrequent visitors' end,
  case when m >= 4 then 'High spenders' when m >= 2 then 'Medium spenders' else 'Low/no spend' end, case when opens > 5 then 'Email engaged' end, case when clicks > 3 then 'Ad responsive' end],
  lambda x: x is not null), ', ')"""
SEG = f"""select cluster, {NAME} as name, size, {rnd('size / sum(size) over () * 100', 1)} as percentage, {rnd('rev * 12', 2)} as avg_ltv, {rnd('s', 1)} as avg_sessions, {rnd('rev', 2)} as avg_revenue,
  {rnd('e', 1)} as avg_engagement, {rnd('r', 2)} as recency_score, {rnd('f', 2)} as frequency_score, {rnd('m', 2)} as monetary_score, {TRAITS} as key_traits,
  row_number() over (order by size desc, cluster) as rank from ({RAW_SEG})"""


@query("u10_segment_profile", "user_profiles", f"select * exclude (key_traits, rank), rank::bigint as rank from ({SEG})")
def _(t):
    return U.segment_profile(fixed_clusters(t)).drop("key_traits").withColumn("rank", F.col("rank").cast("bigint"))


@query("a12_audience_fleet", "user_profiles", f"select sum(size)::bigint as total_audience, avg(avg_ltv) as avg_ltv from ({SEG})", r="avg_ltv")
def _(t):
    return A.audience_fleet(U.segment_profile(fixed_clusters(t)))


@query("u11_rfm", "user_profiles", f"select cluster, r, f, m from ({RAW_SEG})", r="r f m")
def _(t):
    g = fixed_clusters(t).groupBy("cluster").agg(F.avg("days_since_last_visit").alias("d"), F.avg("sessions_30d").alias("s"), F.avg("total_revenue_30d").alias("v"))
    return g.select("cluster", U.rfm_recency(F.col("d")).alias("r"), U.rfm_frequency(F.col("s")).alias("f"), U.rfm_monetary(F.col("v")).alias("m"))


GRID = "select user_id, (user_id % 9) / 2::double + 1 as r, (user_id % 7) / 2::double + 1 as f, (user_id % 8) / 2::double + 1 as m from user_profiles"


@query("u12_archetype", "user_profiles", f"select user_id, {NAME} as name from ({GRID})")
def _(t):
    k = F.col("user_id")
    return t.user_profiles.select(k, U.archetype((k % 9) / 2 + 1, (k % 7) / 2 + 1, (k % 8) / 2 + 1).alias("name"))


@query("u13_key_traits", "user_profiles", f"select cluster, key_traits from ({SEG})")
def _(t):
    return U.segment_profile(fixed_clusters(t)).select("cluster", F.array_join("key_traits", ", ").alias("key_traits"))


GROWTH = """select *, avg_engagement > 50 and monetary_score < 3 as hi, recency_score < 3 and monetary_score >= 3 as wake from ({src})"""


@query("u14_segment_value", "user_profiles", f"""
select cluster, {rnd('avg_ltv * size', 2)} as annual_value, case when hi then 'High' when wake then 'Medium - Reactivation' else 'Low' end as growth_potential,
  {rnd('avg_revenue * case when hi then 0.5 when wake then 0.3 else 0.1 end * size', 2)} as potential_uplift from ({GROWTH.format(src=SEG)})""")
def _(t):
    return U.segment_value(U.segment_profile(fixed_clusters(t))).select("cluster", "annual_value", "growth_potential", "potential_uplift")


def case_sql(d, default):
    whens = " ".join("when '" + k.replace("'", "''") + "' then '" + v.replace("'", "''") + "'" for k, v in d.items())
    return f"case name {whens} else '{default}' end"


@query("u15_strategy", "user_profiles", f"select user_id, {case_sql(U.STRATEGIES, U.DEFAULT_STRATEGY)} as strategy from (select user_id, {NAME} as name from ({GRID}))")
def _(t):
    k = F.col("user_id")
    return t.user_profiles.select(k, U.strategy(U.archetype((k % 9) / 2 + 1, (k % 7) / 2 + 1, (k % 8) / 2 + 1)).alias("strategy"))


def seed_sql(term):
    sums = " + ".join(term.format(x=f, m=f"m_{f}", v=f"v_{f}") for f in U.FEATURES)
    stats = ", ".join(f"avg({f}) as m_{f}, var_pop({f}) as v_{f}" for f in U.FEATURES)
    return f"""select user_id, 1 / (1 + sqrt({sums})) as similarity from ({US}) u, (select {stats} from ({US}) where purchases_30d >= 16) where purchases_30d < 16"""


def seed_pool(t):
    s = scored(t)
    return s.where("purchases_30d >= 16"), s.where("purchases_30d < 16")


@query("u16_lookalike_topn", "user_profiles", f"""
select * from ({seed_sql('pow(({x} - {m}) / (sqrt({v}) + 0.001), 2)')}) order by similarity desc, user_id
limit (select floor(count(*) * 1.5)::bigint from user_profiles where purchases_30d >= 16)""", r="similarity", digits=6)
def _(t):
    seed, pool = seed_pool(t)
    return U.lookalike_topn(seed, pool, 1.5)


THRESHOLD = f"select * from ({seed_sql('({x} - {m}) ** 2 / ({v} + 1e-10)')}) where similarity >= 0.8 / 4 order by similarity desc, user_id limit 40"


@query("u17_lookalike_threshold", "user_profiles", THRESHOLD, r="similarity", digits=6)
def _(t):
    seed, pool = seed_pool(t)
    return U.lookalike_threshold(seed, pool, 40, 4.0)


@query("u17_lookalike_report", "user_profiles", f"""
select count(*) as lookalike_size, coalesce(avg(similarity), 0) as avg_similarity, coalesce(min(similarity), 0) as min_similarity,
  (select count(*) from user_profiles where purchases_30d >= 16) as seed_size from ({THRESHOLD})""", r="avg_similarity min_similarity", digits=6)
def _(t):
    seed, pool = seed_pool(t)
    return U.lookalike_report(seed, U.lookalike_threshold(seed, pool, 40, 4.0))


DFEAT = ["purchases_30d", "total_revenue_30d", "email_opens_30d", "ad_clicks_30d", "days_since_last_visit", "avg_order_value"]
GROUPS = f"select *, case when purchases_30d >= 16 then 0 when ad_clicks_30d >= 16 then 1 when days_since_last_visit >= 2 then 2 else 3 end as cluster from ({US})"
DIST = f"""with w as (select cluster, {', '.join(f'avg({f})::double as {f}' for f in DFEAT)} from ({GROUPS}) group by 1),
  l as (select cluster, feature, value from w unpivot (value for feature in ({', '.join(DFEAT)}))),
  d as (select l.cluster, l.feature, value, avg(value) over (partition by l.feature) as mean, list_position([{', '.join(repr(f) for f in DFEAT)}], l.feature) as pos from l),
  k as (select cluster, pos, case when value > mean * 1.2 then 'High ' || feature when value < mean * 0.8 then 'Low ' || feature end as word from d),
  n as (select cluster, word, row_number() over (partition by cluster order by pos) as i from k where word is not null)"""


def grouped(t):
    c = F.col
    return scored(t).withColumn("cluster", F.when(c("purchases_30d") >= 16, 0).when(c("ad_clicks_30d") >= 16, 1).when(c("days_since_last_visit") >= 2, 2).otherwise(3))


@query("u18_distinguishing", "user_profiles", f"{DIST} select w.cluster, coalesce(string_agg(word, ', ' order by i), '') as distinguishing from w left join n on n.cluster = w.cluster and i <= 5 group by 1")
def _(t):
    return U.distinguishing(U.centroids(grouped(t), DFEAT)).select("cluster", F.array_join("distinguishing", ", ").alias("distinguishing"))


@query("u19_segment_label", "user_profiles", f"""{DIST}
select w.cluster, coalesce(string_agg(replace(replace(word, 'High ', 'High-'), 'Low ', 'Low-'), ' | ' order by i), 'General Audience') as label from w left join n on n.cluster = w.cluster and i <= 2 group by 1""")
def _(t):
    d = U.distinguishing(U.centroids(grouped(t), DFEAT))
    return d.select("cluster", U.segment_label(F.col("distinguishing")).alias("label"))


@query("u20_segment_summary", "user_profiles", """
with l as (select *, user_id % 4 - 1 as label, total_revenue_30d * 12 as ltv from user_profiles)
select 'seg_' || label as segment_id, count(*) as size, avg(ltv) as avg_value, (select count(*) from l where label = -1) as noise_count from l where label <> -1 group by 1""", r="avg_value")
def _(t):
    return U.segment_summary(t.user_profiles.select((F.col("user_id") % 4 - 1).alias("label"), (F.col("total_revenue_30d") * 12).alias("ltv")))


def centroid_rows(t):
    k = F.col("user_id")
    return t.user_profiles.select(k, F.when(k % 5 != 0, k % 50 + 15.5).alias("avg_age"), ((k % 10) / 10).alias("shopping_frequency"), F.when(k % 3 != 0, (k % 7) / 7).alias("tech_affinity"),
                                  ((k % 4) / 4).alias("fitness_score"))


@query("u21_targeting_meta", "user_profiles", """
with c as (select user_id, case when user_id % 5 <> 0 then user_id % 50 + 15.5::double end as a, (user_id % 10) / 10::double as s, case when user_id % 3 <> 0 then (user_id % 7) / 7::double end as t, (user_id % 4) / 4::double as f from user_profiles)
select user_id, trunc(coalesce(a, 25) - 5)::int as age_min, trunc(coalesce(a, 35) + 10)::int as age_max,
  array_to_string(list_filter([case when s > 0.5 then 'Shopping (Hobby)' end, case when coalesce(t, 0) > 0.5 then 'Technology' end, case when f > 0.5 then 'Fitness and wellness' end], lambda x: x is not null), ', ') as interests from c""")
def _(t):
    r = U.targeting(centroid_rows(t), "meta")
    return r.select("user_id", "targeting.age_min", "targeting.age_max", F.array_join(F.transform("targeting.interests", lambda x: x["name"]), ", ").alias("interests"))


@query("u21_targeting_google", "user_profiles", """
select user_id, array_to_string(list_filter([case when (user_id % 10) / 10 > 0.5 then 'Shoppers/Value Shoppers' end, case when user_id % 3 <> 0 and (user_id % 7) / 7 > 0.5 then 'Technology/Technophiles' end],
  lambda x: x is not null), ', ') as affinity_audiences, 'AGE_RANGE_25_34' as age_range from user_profiles""")
def _(t):
    return U.targeting(centroid_rows(t), "google").select("user_id", F.array_join("targeting.affinity_audiences", ", ").alias("affinity_audiences"), "targeting.age_range")


@query("u21_targeting_tiktok", "user_profiles", "select user_id, 'AGE_25_34, AGE_35_44' as age_groups from user_profiles")
def _(t):
    return U.targeting(centroid_rows(t), "tiktok").select("user_id", F.array_join("targeting.age_groups", ", ").alias("age_groups"))


# two ways to the mean silhouette agree, and it says that the clusters are apart
@query("u22_silhouette", "user_profiles", "select count(*) as users, true as agree, true as apart from user_profiles")
def _(t):
    s = staged(scored(t), "scored")
    clustered = U.assign(s, U.kmeans_standardised(s))
    value = U.silhouette(clustered)
    mean = F.avg("silhouette")
    return U.silhouette_by_moments(clustered).agg(F.count(F.lit(1)).alias("users"), (F.abs(mean - value) < 1e-6).alias("agree"), mean.between(0.0, 1.0).alias("apart"))


# on clusters that SQL can name, every row's silhouette is that of all pairs
@query("u22_silhouette_by_moments", "user_profiles", """
with p as (select user_id, user_id % 3 as cluster, [sessions_30d::double, total_revenue_30d::double / 100, days_since_last_visit::double] as f from user_profiles),
  d as (select a.user_id, a.cluster, b.cluster as other, sum(list_distance(a.f, b.f) ** 2) as s, count(*) as n from p a join p b on true group by all),
  i as (select user_id, s / greatest(n - 1, 1) as inner_d, n from d where cluster = other),
  o as (select user_id, min(s / n) as outer_d from d where cluster <> other group by 1)
select user_id, case when n = 1 then 0 else coalesce((outer_d - inner_d) / nullif(greatest(outer_d, inner_d), 0), 0) end as silhouette from i join o using (user_id)""", r="silhouette")
def _(t):
    from pyspark.ml.functions import array_to_vector
    f = F.array(F.col("sessions_30d").cast("double"), F.col("total_revenue_30d").cast("double") / 100, F.col("days_since_last_visit").cast("double"))
    return U.silhouette_by_moments(t.user_profiles.select("user_id", (F.col("user_id") % 3).alias("cluster"), array_to_vector(f).alias("features")))


# the coreset's weights stand for all users, its cost falls with k, and the elbow is one of the choices
@query("u23_choose_k", "user_profiles", "select count(*) as users, true as weights_add_up, true as cost_falls, true as k_in_range from user_profiles")
def _(t):
    s = staged(scored(t), "scored")
    users, weight = s.count(), U.coreset(s).agg(F.sum("weight")).first()[0]
    costs, k = U.cluster_costs(s, range(2, 6)), U.choose_k(s, range(2, 6))
    return s.agg(F.count(F.lit(1)).alias("users")).select("users", F.lit(abs(weight / users - 1) < 0.05).alias("weights_add_up"),
                                                          F.lit(costs[-1][1] < costs[0][1]).alias("cost_falls"), F.lit(2 <= k <= 5).alias("k_in_range"))


KIND = "select distinct event_type as segment, user_id from events where value > 60"


@query("u24_audience_overlap", "", f"""
with m as ({KIND}), z as (select segment, count(*) as n from m group by 1)
select a.segment as a, b.segment as b, count(*) as shared, count(*) / (any_value(za.n) + any_value(zb.n) - count(*))::double as jaccard, count(*) / least(any_value(za.n), any_value(zb.n))::double as containment
from m a join m b on a.user_id = b.user_id and a.segment < b.segment join z za on za.segment = a.segment join z zb on zb.segment = b.segment group by 1, 2""", r="jaccard containment")
def _(t):
    return U.audience_overlap(t.raw("events").where("value > 60").select(F.col("event_type").alias("segment"), "user_id").distinct())


@query("u25_rule_segment", "", """
select distinct user_id from events a where event_type = 'signup' and not exists (
  select 1 from events b where b.user_id = a.user_id and b.event_type = 'purchase' and b.ts > a.ts and b.ts <= a.ts + interval 7 day)""")
def _(t):
    return U.rule_segment(t.raw("events"), "signup", "purchase", 7)


@query("u26_segment_api_projection", "user_profiles", f"""
select cluster, name, size, avg_sessions / 10 as purchase_frequency, monetary_score * 2 + 30 as avg_age, case when avg_engagement > 60 then 'high' when avg_engagement > 30 then 'medium' else 'low' end as engagement_level,
  frequency_score * 0.005 + 0.02 as avg_ctr, monetary_score * 0.01 + 0.01 as avg_cvr, monetary_score * 0.8 + 2 as avg_roas from ({SEG})""", r="purchase_frequency avg_age avg_ctr avg_cvr avg_roas")
def _(t):
    return U.api_projection(U.segment_profile(fixed_clusters(t)))


# ---- set operations ------------------------------------------------------------------------

@query("z01_union_all", "norm_campaigns", "select platform, count(*) as rows from norm_campaigns group by 1")
def _(t):
    return norm_campaigns(t).groupBy("platform").agg(F.count(F.lit(1)).alias("rows"))


@query("z02_channel_union", "path_channels", "select distinct client_id, channel from path_channels where opens union select client_id, channel from path_channels where closes")
def _(t):
    pc = t.path_channels
    return Z.set_union(pc.where("opens").select("client_id", "channel"), pc.where("closes").select("client_id", "channel"))


@query("z03_audience_intersection", "", """
select user_id from events where event_type = 'purchase' and value > 100 intersect select user_id from events where event_type = 'click' and value > 100""")
def _(t):
    e = t.raw("events").where("value > 100")
    return Z.intersection(e.where("event_type = 'purchase'").select("user_id"), e.where("event_type = 'click'").select("user_id"))


@query("z03_channel_coalition", "path_channels", """
select client_id, path_id, array_to_string(list_sort(list(channel) filter (channel in ('meta', 'google', 'email'))), ',') as members from path_channels group by 1, 2""")
def _(t):
    out = Z.coalition_members(t.path_channels, ["meta", "google", "email"])
    return out.select("client_id", "path_id", F.when(F.size("members") > 0, F.array_join("members", ",")).alias("members"))


@query("z04_audience_difference", "", """
select user_id from events where event_type = 'click' except select user_id from events where event_type = 'purchase' and value > 100""")
def _(t):
    e = t.raw("events")
    return Z.difference(e.where("event_type = 'click'").select("user_id"), e.where("event_type = 'purchase' and value > 100").select("user_id"))


@query("z05_subset_paths", "path_channels", """
select client_id, count(*) as paths, count(*) filter (inside) as subset_paths from (
  select client_id, path_id, bool_and(channel in ('meta', 'google', 'tiktok')) as inside from path_channels group by 1, 2) group by 1""")
def _(t):
    return Z.subset_counts(t.path_channels, ["meta", "google", "tiktok"])
