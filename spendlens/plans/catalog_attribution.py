"""Registered queries: journeys and attribution."""

from pyspark.sql import functions as F

from spendlens.operators import attribution as A
from spendlens.plans.registry import ORACLE, query
from spendlens.plans.views import rnd

JCOLS = "client_id, path_id, event_id, channel, prev_channel, next_channel"


@query("t01_build_journeys", "journeys", f"select {JCOLS}, seq = 1 as is_first, seq = path_touches as is_last from journeys")
def _(t):
    return t.journeys.select(*JCOLS.split(", "), "is_first", "is_last")


@query("t01_build_journeys_lookback", "journeys", """
select user_id, event_id, coalesce(sum(is_conversion::int) over (partition by user_id order by ts, event_id
  rows between unbounded preceding and 1 preceding), 0)::bigint as path_no
from touchpoints where ts >= timestamp '2024-01-31' - interval 14 day""")
def _(t):
    return A.build_journeys(t.touchpoints, as_of="2024-01-31 00:00:00", lookback_days=14).select("user_id", "event_id", "path_no")


@query("t01_paths", "paths", """
select client_id, path_id, converted, value, touchpoints, duration_hours, strftime(first_touch_at, '%Y-%m-%d %H:%M:%S') as first_touch_at from paths
""", r="value duration_hours")
def _(t):
    return t.paths.select("client_id", "path_id", "converted", "value", "touchpoints", "duration_hours",
                          F.date_format("first_touch_at", "yyyy-MM-dd HH:mm:ss").alias("first_touch_at"))


SHARE = "select client_id, channel, sum({c}) / {t} as {n} from path_channels where {w} group by 1, 2"
TOTAL = "sum(sum({c})) over (partition by client_id)"


def share_sql(name, credit, where="converted", floor=False):
    total = TOTAL.format(c=credit)
    return SHARE.format(c=credit, n=name, w=where, t=f"greatest({total}, 1)" if floor else total)


@query("t02_shapley_value", "path_channels", share_sql("shapley", "value / path_channels"), r="shapley")
def _(t):
    return A.shapley_value(t.path_channels)


# Brute-force coalition game over every subset of the five channels.
@query("t03_shapley_rate", "path_channels", """
with bits as (select client_id, channel, row_number() over (partition by client_id order by channel) - 1 as bit
    from (select distinct client_id, channel from path_channels)),
  masks as (select client_id, mask, count(*) as n, count(*) filter (conv) as c from (
    select p.client_id, path_id, sum(1::bigint << bit::int)::bigint as mask, bool_or(converted) as conv
    from path_channels p join bits b on p.client_id = b.client_id and p.channel = b.channel group by 1, 2) group by 1, 2),
  dims as (select client_id, count(*) as n_ch from bits group by 1),
  vals as (select d.client_id, n_ch, s, coalesce(sum(c) filter ((mask & s) <> 0) / nullif(sum(n) filter ((mask & s) <> 0), 0)::double, 0) as v
    from dims d, range(0, 32) g(s), masks m where d.client_id = m.client_id and s < (1 << n_ch::int) group by 1, 2, 3),
  phi as (select b.client_id, channel, sum(factorial(bit_count(x.s)::int)::double * factorial((x.n_ch - bit_count(x.s) - 1)::int)::double
      / factorial(x.n_ch::int)::double * (y.v - x.v)) as phi
    from bits b join vals x on b.client_id = x.client_id and (x.s & (1::bigint << b.bit::int)) = 0
    join vals y on y.client_id = b.client_id and y.s = (x.s | (1::bigint << b.bit::int)) group by 1, 2)
select client_id, channel, case when sum(phi) over w > 0 then phi / sum(phi) over w else phi end as shapley_rate
from phi window w as (partition by client_id)""", r="shapley_rate")
def _(t):
    return A.shapley_rate(t.path_channels)


@query("t04_transition_matrix", "edges", "select client_id, from_state, to_state, n, p from edges", r="p")
def _(t):
    return t.edges


MARKOV_SQL = """
with recursive chan as (select distinct client_id, channel from journeys),
  scen as (select client_id, channel as removed from chan union all select distinct client_id, '' from chan),
  net as (select s.client_id, removed, from_state, to_state, p / sum(p) over (partition by s.client_id, removed, from_state) as p
    from scen s join edges e on s.client_id = e.client_id and from_state <> removed and to_state <> removed),
  walk as (select client_id, removed, 0 as step, 'START' as state, 1::double as mass, 1::double as live from scen
    union all
    select client_id, removed, step, state, mass, live from (
      select w.client_id, w.removed, w.step + 1 as step, n.to_state as state, sum(w.mass * n.p)::double as mass,
        sum(sum(w.mass * n.p)) over (partition by w.client_id, w.removed)::double as live
      from walk w join net n on w.client_id = n.client_id and w.removed = n.removed and n.from_state = w.state
      where w.step < 99 group by w.client_id, w.removed, w.step, n.to_state) where live >= 0.001),
  rates as (select client_id, removed, sum(case when state = 'CONVERSION' then mass else 0 end) as rate from walk group by 1, 2),
  eff as (select r.client_id, r.removed as channel, b.rate as base_rate, r.rate as removed_rate, greatest(0, b.rate - r.rate) as e
    from rates r join rates b on r.client_id = b.client_id and b.removed = '' where r.removed <> '')
select client_id, channel, base_rate, removed_rate,
  case when sum(e) over (partition by client_id) > 0 then e / sum(e) over (partition by client_id) else 0 end as markov from eff"""


@query("t05_markov_removal", "edges", MARKOV_SQL, r="base_rate removed_rate markov")
def _(t):
    return A.markov_removal(t.edges)


GREEDY_SQL = """
with recursive chan as (select distinct client_id, channel from journeys),
  scen as (select client_id, channel as removed from chan union all select distinct client_id, '' from chan),
  net as materialized (select s.client_id, removed, from_state, to_state, p / case when removed = '' then 1 else sum(p) over (partition by s.client_id, removed, from_state) end as p
    from scen s join edges e on s.client_id = e.client_id and from_state <> removed and to_state <> removed),
  states as materialized (select client_id, removed, from_state, max(p) filter (to_state = 'CONVERSION') as conversion,
    min(to_state) filter (to_state not in ('CONVERSION', 'NULL') and p = best) as way, max(best) as way_p
    from (select *, max(p) filter (to_state not in ('CONVERSION', 'NULL')) over (partition by client_id, removed, from_state) as best from net) group by 1, 2, 3),
  walk as (select client_id, removed, 1 as step, 'START' as here, 1::double as p, []::varchar[] as seen from scen
    union all
    select w.client_id, w.removed, step + 1, way, w.p * way_p, list_append(seen, here)
    from walk w join states s on s.client_id = w.client_id and s.removed = w.removed and s.from_state = w.here
    where step < 20 and conversion is null and way is not null and not list_contains(seen, here)),
  rates as (select c.client_id, c.removed, coalesce(max(w.p * s.conversion), 0) as rate from scen c
    left join walk w on w.client_id = c.client_id and w.removed = c.removed and not list_contains(w.seen, w.here)
    left join states s on s.client_id = w.client_id and s.removed = w.removed and s.from_state = w.here group by 1, 2),
  eff as (select r.client_id, r.removed as channel, b.rate as base_rate, r.rate as removed_rate, greatest(0, b.rate - r.rate) as e
    from rates r join rates b on r.client_id = b.client_id and b.removed = '' where r.removed <> '')
select client_id, channel, base_rate, removed_rate,
  case when sum(e) over (partition by client_id) > 0 then e / sum(e) over (partition by client_id) else 1 / count(*) over (partition by client_id)::double end as markov_greedy from eff"""


@query("t06_markov_greedy", "edges", GREEDY_SQL, r="base_rate removed_rate markov_greedy")
def _(t):
    return A.markov_greedy(t.edges)


@query("t07_first_touch", "path_channels", share_sql("first_touch", "value", "converted and opens"), r="first_touch")
def _(t):
    return A.first_touch(t.path_channels)


@query("t07_first_touch_floor", "path_channels", share_sql("first_touch", "value", "converted and opens", True), r="first_touch")
def _(t):
    return A.first_touch(t.path_channels, floor=1.0)


@query("t08_last_touch", "path_channels", share_sql("last_touch", "value", "converted and closes"), r="last_touch")
def _(t):
    return A.last_touch(t.path_channels)


@query("t09_linear", "path_channels", share_sql("linear", "value * n / path_touches"), r="linear")
def _(t):
    return A.linear(t.path_channels)


DECAY = """
select j.client_id, j.path_id, event_id, channel, p.value,
  pow(2, -(epoch_us(p.last_touch_at) - epoch_us(j.ts)) / 86400e6 / 7) as w, seq, path_touches
from journeys j join paths p on j.path_id = p.path_id where p.converted"""


@query("t10_time_decay", "journeys paths", f"""
select client_id, channel, sum(value * w / tw) / greatest(sum(sum(value * w / tw)) over (partition by client_id), 1) as time_decay
from (select *, sum(w) over (partition by path_id) as tw from ({DECAY})) group by 1, 2""", r="time_decay")
def _(t):
    return A.time_decay(t.journeys)


USHAPE = """case when path_touches = 1 then 1 when path_touches = 2 then 0.5 when seq = 1 or seq = path_touches then 0.4
  else 0.2 / (path_touches - 2) end::double"""


@query("t11_position_based", "journeys paths", f"""
select client_id, channel, sum(value * u) / sum(sum(value * u)) over (partition by client_id) as position_based
from (select *, {USHAPE} as u from ({DECAY})) group by 1, 2""", r="position_based")
def _(t):
    return A.position_based(t.journeys, t.paths)


def split_sql(model):
    return (f"coalesce({model} / nullif(sum({model} / k) over (partition by path_id), 0), 0) * value / k")


@query("t12_touchpoint_attributions", "edges path_channels", f"""
with recursive mk as (select client_id, channel, markov from ({{markov}})),
  sv as ({share_sql('shapley', 'value / path_channels')}),
  base as (select d.*, k, shapley, markov, sum(w) over (partition by d.path_id) as tw from ({DECAY}) d
    join (select path_id, channel, n as k from path_channels) c on c.path_id = d.path_id and c.channel = d.channel
    join sv on sv.client_id = d.client_id and sv.channel = d.channel join mk on mk.client_id = d.client_id and mk.channel = d.channel)
select client_id, path_id, event_id, channel,
  case when seq = 1 then value else 0 end as first_touch_value, case when seq = path_touches then value else 0 end as last_touch_value,
  value / path_touches as linear_value, value * w / tw as time_decay_value, value * {USHAPE} as position_value,
  {split_sql('shapley')} as shapley_value, {split_sql('markov')} as markov_value from base""".replace("{markov}", MARKOV_SQL),
       r="first_touch_value last_touch_value linear_value time_decay_value position_value shapley_value markov_value")
def _(t):
    return A.touchpoint_attributions(t.journeys)


REPORT_PARTS = f"""
  st as (select client_id, channel, sum(n)::bigint as touchpoints, sum(cost) as cost, count(*) filter (converted) as conversions from path_channels group by 1, 2),
  sv as ({share_sql('shapley', 'value / path_channels')}), ft as ({share_sql('first_touch', 'value', 'converted and opens')}),
  lt as ({share_sql('last_touch', 'value', 'converted and closes')}), li as ({share_sql('linear', 'value * n / path_touches')}),
  tot as (select client_id, sum(case when converted then value else 0 end) as tv from paths group by 1),
  report as (select client_id, channel, {rnd('coalesce(shapley, 0)', 4)} as shapley, {rnd('coalesce(markov, 0)', 4)} as markov,
    {rnd('coalesce(first_touch, 0)', 4)} as first_touch, {rnd('coalesce(last_touch, 0)', 4)} as last_touch,
    {rnd('coalesce(linear, 0)', 4)} as linear, {rnd('coalesce(shapley, 0) * 100', 2)} as contribution_pct, touchpoints, conversions,
    {rnd('cost', 2)} as cost, {rnd('tv * coalesce(shapley, 0)', 2)} as attributed_value,
    row_number() over (partition by client_id order by coalesce(shapley, 0) desc, channel) as rank
    from st left join sv using (client_id, channel) left join mk using (client_id, channel) left join ft using (client_id, channel)
    left join lt using (client_id, channel) left join li using (client_id, channel) left join tot using (client_id))"""
REPORT = f"with recursive mk as (select client_id, channel, markov from ({MARKOV_SQL})), {REPORT_PARTS} "


@query("t13_attribution_report", "edges path_channels", REPORT + "select * from report")
def _(t):
    return A.attribution_report(t.journeys)


@query("t13_attribution_report_range", "edges path_channels", REPORT.replace("coalesce(shapley, 0) * 100", "coalesce(last_touch, 0) * 100").replace(
    "order by coalesce(shapley, 0) desc", "order by coalesce(last_touch, 0) desc") + "select * from report")
def _(t):
    return A.attribution_report(t.journeys, "2024-01-10", "2024-01-20", model="last_touch")


# The same views over the paths whose last touch lies in the range.
ORACLE["t13_attribution_report_range"] = ORACLE["t13_attribution_report_range"].replace("journeys as (", "every_journey as (", 1).replace(
    "edges as (", """journeys as (select * from every_journey where path_id in (
  select path_id from every_journey where seq = path_touches and ts::date between date '2024-01-10' and date '2024-01-20')),
edges as (""", 1)


@query("t14_attribution_insights", "edges path_channels", REPORT + """
select client_id, position, insight from (
  select client_id, row_number() over (partition by client_id order by rule, rank) as position, insight from (
    select client_id, rank, 0 as rule, channel || ' is the top contributor with ' || printf('%.1f', contribution_pct) || '% attribution' as insight
      from report where rank = 1
    union all select client_id, rank, 1, channel || case when first_touch > last_touch then ' is stronger at awareness (first touch) than conversion (last touch)'
      else ' is stronger at conversion (last touch) than awareness (first touch)' end from report where rank <= 3 and abs(first_touch - last_touch) > 0.15
    union all select client_id, rank, 2, 'Models disagree on ' || channel || ' - consider deeper analysis' from report where abs(shapley - markov) > 0.1))
where position <= 5""")
def _(t):
    return A.attribution_insights(A.attribution_report(t.journeys)).withColumn("position", F.col("position").cast("bigint"))


@query("t15_path_analysis", "journeys paths", """
select path, count(*) filter (converted) as conversions, count(*) as total_paths,
  sum(case when converted then value else 0 end) as total_value,
  sum(case when converted then value else 0 end) / count(*) filter (converted) as avg_value,
  count(*) filter (converted) / count(*)::double as conversion_rate
from (select p.path_id, p.converted, p.value, string_agg(channel, ' → ' order by seq) as path
  from journeys j join paths p on j.path_id = p.path_id group by 1, 2, 3)
group by 1 having count(*) filter (converted) >= 5 order by 2 desc, 1 limit 20""", r="total_value avg_value conversion_rate")
def _(t):
    return A.path_analysis(t.journeys, t.paths)


@query("t16_channel_synergy", "path_channels", """
with s as (select path_id, channel, converted from path_channels),
  b as (select channel, avg(converted::int) as base from s group by 1)
select x.channel as channel_a, y.channel as channel_b, count(*) as paths, avg(x.converted::int) as rate, avg(x.converted::int) / any_value(base) as lift
from s x join s y on x.path_id = y.path_id and x.channel <> y.channel join b on b.channel = x.channel group by 1, 2""", r="rate lift")
def _(t):
    return A.channel_synergy(t.path_channels)


@query("t17_budget_by_attribution", "path_channels", f"""
select client_id, channel, 10000 * shapley / sum(shapley) over (partition by client_id) as recommended_budget
from (select client_id, channel, {rnd('shapley', 4)} as shapley from ({share_sql('shapley', 'value / path_channels')}))""", r="recommended_budget", digits=2)
def _(t):
    report = A.shapley_value(t.path_channels).withColumn("shapley", F.round("shapley", 4))
    spend = A.channel_stats(t.path_channels).select("client_id", "channel", F.col("cost").alias("current_budget"))
    return A.budget_by_attribution(report, 10000.0, spend)


@query("t18_single_vs_multi_channel", "path_channels", """
select case when path_channels = 1 then 'single' else 'multi' end as kind, count(*) as paths, avg(converted::int) as conversion_rate
from path_channels where opens group by 1""", r="conversion_rate")
def _(t):
    return A.single_vs_multi_channel(t.path_channels)


@query("t19_budget_shift", "path_channels", f"""
with sp as (select client_id, channel, sum(cost) as spend from path_channels group by 1, 2)
select client_id, channel, spend / sum(spend) over w as spend_share, shapley,
  (shapley - spend / sum(spend) over w) / nullif(spend / sum(spend) over w, 0) * 100 as shift_pct
from ({share_sql('shapley', 'value / path_channels')}) join sp using (client_id, channel) window w as (partition by client_id)""",
       r="spend_share shapley shift_pct")
def _(t):
    spend = A.channel_stats(t.path_channels).select("client_id", "channel", F.col("cost").alias("spend"))
    return A.budget_shift(A.shapley_value(t.path_channels), spend)


@query("a07_channel_stats", "path_channels", """
select client_id, channel, sum(n)::bigint as touchpoints, sum(cost) as cost, count(*) filter (converted) as conversions
from path_channels group by 1, 2""", r="cost")
def _(t):
    return A.channel_stats(t.path_channels)


@query("a08_report_totals", "paths", """
select client_id, count(*) filter (converted) as conversions, sum(case when converted then value else 0 end) as total_value,
  avg(touchpoints) as avg_touchpoints from paths group by 1""", r="total_value avg_touchpoints")
def _(t):
    return A.report_totals(t.paths)


@query("a09_path_length_distribution", "paths", "select touchpoints, count(*) as paths from paths where converted group by 1")
def _(t):
    return A.path_length_distribution(t.paths)


@query("w17_journey_features", "journeys", """
with c as (select *, case channel when 'meta' then 1 when 'google' then 2 when 'tiktok' then 3 when 'email' then 4 when 'organic' then 5 else 0 end as code from journeys)
select client_id, path_id, count(*) as touchpoint_count, count(distinct channel) as unique_channels,
  count(*) filter (prev_channel <> channel) as channel_switches,
  floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6)::bigint as journey_duration_days,
  min(case when seq = 1 then code end) as first_channel_code, max(case when seq = path_touches then code end) as last_channel_code
from c group by 1, 2""")
def _(t):
    return A.journey_features(t.journeys)


@query("w18_days_to_convert", "paths", """
select client_id, path_id, datediff('day', first_touch_at::date, last_touch_at::date) as days, duration_hours from paths where converted
""", r="duration_hours")
def _(t):
    return A.days_to_convert(t.paths)
