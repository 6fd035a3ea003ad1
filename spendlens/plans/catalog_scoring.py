"""Registered queries: client health, creatives, budgets, alerts, monitoring."""

from pyspark.sql import functions as F


from spendlens.operators import aggregates as A
from spendlens.operators import alerts as L
from spendlens.operators import budget as O
from spendlens.operators import creative as R
from spendlens.operators import health as C
from spendlens.operators import monitoring as M
from spendlens.operators import timeseries as W
from spendlens.operators.monitoring import beats_constant, calibration
from spendlens.plans.catalog_metrics import BENCH, DRIFT, FORECAST, MATCHED, forecasts
from spendlens.plans.registry import query
from spendlens.plans.views import AS_OF_ORDERS, pick, rnd
from spendlens.session import staged

# ---- health --------------------------------------------------------------------------------

SCORES = "overall_score, roas_score, engagement_score, payment_score, communication_score, growth_score"


@query("c01_health_score", "health", f"select client_id, {SCORES} from health")
def _(t):
    return C.health_score(t.client_metrics).select("client_id", *SCORES.split(", "))


@query("c02_risk_factors", "factors", "select client_id, pos, factor, severity, impact, description, trend from factors")
def _(t):
    rows = C.risk_factors(t.client_metrics).select("client_id", F.posexplode("risk_factors").alias("pos", "f"))
    return rows.select("client_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "f.factor", "f.severity", "f.impact", "f.description", "f.trend")


@query("c03_churn", "scored", "select client_id, churn_probability, risk_level, days_to_churn, predicted_churn_date from scored")
def _(t):
    return t.scored.select("client_id", "churn_probability", "risk_level", "days_to_churn", "predicted_churn_date")


def advice_values():
    rows = [f"({f!r}, {i}, {x!r})".replace('"', "'") for f, texts in C.ADVICE.items() for i, x in enumerate(texts)]
    return f"(values {', '.join(rows)}) a(factor, i, txt)"


@query("c04_recommendations", "factors", f"""
select client_id, string_agg(txt, ' / ' order by n) as recommendations from (
  select client_id, txt, row_number() over (partition by client_id order by pos, a.i) as n from factors f join {advice_values()} on a.factor = f.factor where pos <= 3)
where n <= 5 group by 1""")
def _(t):
    return t.scored.where("size(recommendations) > 0").select("client_id", F.array_join("recommendations", " / ").alias("recommendations"))


V2 = """select *, trunc(roas_score * 0.25::double + engagement_score * 0.2::double + payment_score * 0.15::double + communication_score * 0.2::double + growth_score * 0.2::double)::int as overall_score from (
  select *, case when target_roas > 0 then least(100, trunc(current_roas / target_roas * 100)::int) else 50 end as roas_score,
    trunc(least(100, logins_30d * 5) * 0.6::double + trunc(meeting_rate * 100) * 0.4::double)::int as engagement_score,
    greatest(0, 100 - least(100, payment_delay_days * 10))::double as payment_score,
    greatest(0, 100 - least(100, response_hours * 2) - least(50, last_contact_days * 2))::double as communication_score,
    greatest(0, least(100, revenue_mom_change * 200 + 50))::double as growth_score from client_features)"""


@query("c05_health_score_v2", "client_features", f"select client_id, {SCORES} from ({V2})", r="payment_score communication_score growth_score")
def _(t):
    return C.health_score_v2(t.client_features).select("client_id", *SCORES.split(", "))


F10 = """select *, (f_roas_ratio + f_roas_trend + f_login + f_login_change + f_response + f_payment + f_mom + f_tenure + f_contract + f_sentiment) / 10 as mean_f from (
  select *, case when target_roas > 0 then current_roas / target_roas else 1 end as f_roas_ratio, roas_trend as f_roas_trend, logins_30d / 30::double as f_login,
    logins_7d / 7::double - logins_30d / 30::double as f_login_change, 1 / (1 + response_hours / 24) as f_response, 1 / (1 + payment_delay_days / 30) as f_payment,
    revenue_mom_change as f_mom, ln(1 + tenure_months) as f_tenure, coalesce(contract_days_remaining, 365) / 365::double as f_contract,
    case when tickets_30d > 0 then ticket_sentiment else 0.5::double end as f_sentiment from client_features)"""
FNAMES = "f_roas_ratio f_roas_trend f_login f_login_change f_response f_payment f_mom f_tenure f_contract f_sentiment"


@query("c06_churn_features_v2", "client_features", f"select client_id, {FNAMES.replace(' ', ', ')} from ({F10})", r=FNAMES)
def _(t):
    return C.churn_features(t.client_features).select("client_id", *FNAMES.split())


@query("c07_churn_v2", "client_features", f"""
with p as (select *, greatest(0.05, least(0.95, 0.3 * (1 - least(1, f_roas_ratio)) + 0.2 * (1 - least(1, f_login * 5)) + 0.15 * (1 - f_response) + 0.15 * (1 - f_payment)
    + 0.2 * greatest(0, -f_mom))) as p_boosted, greatest(0.05, least(0.95, mean_f * 0.5)) as p_mean from ({F10})),
  q as (select *, (p_boosted + p_mean) / 2 as churn_probability, (select min(d) from range(30, 361, 30) r(d) where exp(-0.005 * d * (1 + mean_f)) < 0.5)::int as median_survival_days from p)
select client_id, p_boosted, p_mean, churn_probability, case when churn_probability >= 0.7 then 'critical' when churn_probability >= 0.5 then 'warning'
  when churn_probability >= 0.3 then 'monitor' else 'healthy' end as risk_level, median_survival_days, date '{AS_OF_ORDERS}' + median_survival_days as predicted_churn_date from q""",
       r="p_boosted p_mean churn_probability")
def _(t):
    return C.churn_v2(C.churn_features(t.client_features), AS_OF_ORDERS).select(
        "client_id", "p_boosted", "p_mean", "churn_probability", "risk_level", "median_survival_days", "predicted_churn_date")


@query("c08_survival_curve", "client_features", f"""
select client_id, d::int as days, exp(-0.005 * d * (1 + mean_f)) as p from ({F10}), (values (30), (60), (90), (120), (180)) v(d)""", r="p")
def _(t):
    return C.survival(C.churn_features(t.client_features)).select("client_id", F.inline("survival_curve"))


@query("c09_risk_factors_v2", "client_features", f"""
select client_id, row_number() over (partition by client_id order by impact desc, i) as pos, factor, severity, impact::double as impact, description, trend from (
  select client_id, 1 as i, 'Below Target ROAS' as factor, case when roas_score < 50 then 'high' else 'medium' end as severity, 0.25 as impact,
    printf('ROAS at %.2fx vs target %.2fx', current_roas, target_roas) as description, case when roas_trend < 0 then 'declining' else 'stable' end as trend from ({V2}) where roas_score < 70
  union all select client_id, 2, 'Low Engagement', 'medium', 0.20, printf('Only %d dashboard logins in 30 days', logins_30d), 'declining' from ({V2}) where engagement_score < 60
  union all select client_id, 3, 'Communication Gap', 'medium', 0.20, printf('Average response time: %.0f hours', response_hours), 'declining' from ({V2}) where communication_score < 60
  union all select client_id, 4, 'Payment Delays', 'medium', 0.15, printf('Average payment delay: %.0f days', payment_delay_days), 'stable' from ({V2}) where payment_score < 80
  union all select client_id, 5, 'Revenue Decline', 'high', 0.20, printf('Revenue down %.0f%% month-over-month', abs(revenue_mom_change) * 100), 'declining' from ({V2}) where revenue_mom_change < -0.1)""")
def _(t):
    rows = C.risk_factors_v2(C.health_score_v2(t.client_features)).select("client_id", F.posexplode("risk_factors").alias("pos", "f"))
    return rows.select("client_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "f.factor", "f.severity", "f.impact", "f.description", "f.trend")


@query("c10_snapshot", "scored", f"""
select client_id, date '{AS_OF_ORDERS}' as snapshot_date, trunc(overall_score)::int as overall_score, roas_score, churn_probability, days_to_churn from scored""")
def _(t):
    return C.snapshot(t.scored, AS_OF_ORDERS).select("client_id", "snapshot_date", "overall_score", "roas_score", "churn_probability", "days_to_churn")


@query("c11_at_risk_alert_rows", "scored", """
select client_id, risk_level as alert_type, churn_probability, overall_score from scored where risk_level in ('critical', 'warning')""")
def _(t):
    return C.alert_rows(t.scored)


CHURNED = "actual_roas + days_since_login * -0.05::double < 1.5"


def churn_label():
    return F.col("actual_roas") + F.col("days_since_login") * -0.05 < 1.5


# scores of clients the model has not seen: better than the mean of the others
@query("c12_train_churn", "client_metrics", "select count(*) as rows, true as better from client_metrics")
def _(t):
    return beats_constant(C.churn_scores(t.client_metrics, churn_label()))


# the calibration table covers every client and all that churn
@query("c12_churn_calibration", "client_metrics", f"select count(*) as clients, count(*) filter ({CHURNED}) as churned, true as rises from client_metrics")
def _(t):
    bins = calibration(C.churn_scores(t.client_metrics, churn_label()))
    ends = F.max_by("share", "bin") > F.min_by("share", "bin")
    return bins.agg(F.sum("rows").alias("clients"), F.round(F.sum(F.col("rows") * F.col("share"))).cast("long").alias("churned"), ends.alias("rises"))


@query("c13_score_bands", "health", """
select client_id, case when overall_score < 30 then 'critical' when overall_score < 50 then 'warning' when overall_score < 70 then 'monitor' else 'healthy' end as band from health""")
def _(t):
    return C.health_score(t.client_metrics).select("client_id", C.score_band(F.col("overall_score")).alias("band"))


# ---- creatives -----------------------------------------------------------------------------

TEXT = "headline || ' ' || coalesce(body, '')"
WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def count_sql(pattern, x):
    return f"length(regexp_replace({x}, '{pattern}', '', 'g'))"


def n_sql(pattern, x="t"):
    return f"(length({x}) - {count_sql(pattern, x)})"


def tokens_sql(tokens):
    return f"len(list_filter(w, lambda x: x in ({', '.join(repr(v) for v in tokens)})))"


def hits_sql(vocabulary, x="low"):
    return "(" + " + ".join(f"contains({x}, {w!r})::int" for w in vocabulary) + ")"


@query("r01_store_features", "creatives", f"""
select creative_id, length(headline) as headline_length, length(coalesce(body, '')) as body_length, length(t) as total_text_length, len(w) as word_count,
  {n_sql(chr(92) + 'p{Lu}')} / greatest(length(t), 1)::double as uppercase_ratio, {n_sql(chr(92) + 'p{Nd}')} as digit_count, {n_sql('[!?.,;:]')} as punctuation_count,
  {n_sql('!')} as exclamation_count, {n_sql('[?]')} as question_count, {n_sql('[' + chr(92) + 'x{1F019}-' + chr(92) + 'x{10FFFF}]')} as emoji_count,
  coalesce(case coalesce(cta, 'LEARN_MORE') {' '.join(f"when '{k}' then {v}" for k, v in R.CTA_CODES.items())} end, 0) as cta_type_encoded,
  {tokens_sql(R.POWER_TOKENS)} as power_word_count, {tokens_sql(R.URGENCY_TOKENS)} as urgency_score, {tokens_sql(R.SOCIAL_TOKENS)} as social_proof_score
from (select *, {WORDS.format(x='lower(t)')} as w from (select *, {TEXT} as t from creatives))""", r="uppercase_ratio", digits=6)
def _(t):
    out = R.store_features(t.creatives)
    return out.select(*[F.col(n).cast("bigint").alias(n) if n not in ("creative_id", "uppercase_ratio", "cta_type_encoded") else F.col(n) for n in out.columns])


PRED = f"""select *, least(1, 0.3::double + {hits_sql(R.POWER_WORDS['urgency'])} * 0.1::double + case when replace(lower(coalesce(cta, '')), ' ', '_') in
    ({', '.join(repr(x) for x in R.URGENT_CTAS)}) then 0.2 else 0 end::double) as urgency, case when p + n = 0 then 0.6::double else 0.5::double + (p - n) * 0.1::double end as sentiment,
    greatest(0, least(100, 100 - length(regexp_replace(t, '\\s+', '', 'g')) / greatest(nw, 1)::double * 5 - nw / greatest({n_sql('[.!?]')}, 1)::double * 2)) as readability,
    {', '.join(f"least(1, {hits_sql(v)} * 0.25::double) as power_{k}" for k, v in R.POWER_WORDS.items())}
  from (select *, lower(t) as low, len({WORDS.format(x='t')}) as nw, len({WORDS.format(x='headline')}) as headline_words, regexp_matches(headline, '\\p{{Nd}}') as has_numbers,
    contains(headline, '?') as has_question, regexp_matches(headline, '[\\x{{1F300}}-\\x{{1F9FF}}]') as has_emoji,
    {hits_sql(R.POSITIVE, 'lower(t)')} as p, {hits_sql(R.NEGATIVE, 'lower(t)')} as n from (select *, {TEXT} as t from creatives))"""
PCOLS = "power_urgency power_exclusivity power_benefit power_emotion"


@query("r02_predictor_features", "creatives", """
select creative_id, length(headline) as headline_length, len(list_filter(regexp_split_to_array(headline, '\\s+'), lambda w: w <> '')) as headline_words,
  regexp_matches(headline, '\\p{Nd}') as has_numbers, contains(headline, '?') as has_question, contains(headline, '!') as has_exclamation,
  regexp_matches(headline, '[\\x{1F300}-\\x{1F9FF}]') as has_emoji from creatives""")
def _(t):
    return R.predictor_features(t.creatives).select("creative_id", F.col("headline_length").cast("bigint").alias("headline_length"),
                                                    F.col("headline_words").cast("bigint").alias("headline_words"), "has_numbers", "has_question", "has_exclamation", "has_emoji")


for _name, _cols in {"r03_sentiment": "sentiment", "r04_readability": "readability", "r05_cta_urgency": "urgency", "r06_power_scores": PCOLS}.items():
    @query(_name, "creatives", f"select creative_id, {_cols.replace(' ', ', ')} from ({PRED})", r=_cols)
    def _(t, cols=_cols):
        return R.predictor_features(t.creatives).select("creative_id", *cols.split())


COLORS = ["Blue", "red", "teal", "white", "black"]


def creative_colors(t):
    d = F.col("creative_id")
    some = F.when(d % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(COLORS, d % 5), pick(COLORS, (d + 2) % 5)))
    return t.creatives.select("creative_id", some.alias("colors"))


COLOR_ROWS = """select creative_id, unnest([(['blue','red','teal','white','black'])[creative_id % 5 + 1], (['blue','red','teal','white','black'])[(creative_id + 2) % 5 + 1]]) as color
  from creatives where creative_id % 7 <> 0"""


@query("r07_color_score", "creatives", f"""
select creative_id, coalesce(s, 0.7::double) as color_score from creatives left join (
  select creative_id, least(1, avg(case color {' '.join(f"when '{k}' then {v}" for k, v in R.COLOR_SCORES.items())} else 0.6 end::double)) as s from ({COLOR_ROWS}) group by 1) using (creative_id)""",
       r="color_score")
def _(t):
    return creative_colors(t).select("creative_id", R.color_score(F.col("colors")).alias("color_score"))


MODIFIED = f"""select c.*, 0.75::double as color_score, least(0.1, bi.ctr * bp.ctr * m) as ctr0, least(0.05, bi.cvr * bp.cvr * m * 0.9) as cvr0,
    0.75 + case when coalesce(body, '') <> '' then 0.05 else 0 end + case when coalesce(cta, '') <> '' then 0.05 else 0 end as conf,
    least(100, headline_words * 3 + urgency * 30 + 50 + case when has_question then 15 else 0 end) as hook, ('0x' || substr(md5(headline), 1, 8))::bigint % 20 + 70 as brand
  from (select *, case when headline_words between 5 and 8 then 1.15 when headline_words > 12 then 0.85 else 1 end::double * case when has_numbers then 1.12 else 1 end::double
    * case when has_question then 1.08 else 1 end::double * case when has_face then 1.18 else 1 end::double * (urgency * 0.15 + 1)
    * (power_urgency * 0.05 + 1) * (power_exclusivity * 0.05 + 1) * (power_benefit * 0.05 + 1) * (power_emotion * 0.05 + 1) * (0.75::double * 0.4 + 0.8) as m from ({PRED})) c {BENCH}"""


@query("r08_predict_ctr_cvr", "creatives", f"select creative_id, {rnd('ctr0', 4)} as predicted_ctr, {rnd('cvr0', 4)} as predicted_cvr from ({MODIFIED})")
def _(t):
    return R.predict(t.creatives).select("creative_id", "predicted_ctr", "predicted_cvr")


QUALITY = f"""select creative_id, ad_set_id, {rnd('conf', 2)} as confidence, {rnd('hook', 1)} as hook_score, 75::double as color_psychology_score, brand::double as brand_consistency_score,
  {rnd('sentiment * 100', 1)} as text_sentiment_score, {rnd('readability', 1)} as readability_score,
  {rnd('(hook + 75 + brand + sentiment * 100 + readability) / 5', 1)} as overall_quality_score from ({MODIFIED})"""
QCOLS = "confidence hook_score color_psychology_score brand_consistency_score text_sentiment_score readability_score overall_quality_score"


@query("r09_quality_scores", "creatives", f"select creative_id, {QCOLS.replace(' ', ', ')} from ({QUALITY})")
def _(t):
    return R.predict(t.creatives).select("creative_id", *QCOLS.split())


def say_sql(key):
    return "'" + R.ADVICE[key].replace("'", "''") + "'"


ADVICE_SQL = f"""list_filter([case when headline_words < 5 then {say_sql('short')} when headline_words > 10 then {say_sql('long')} end, case when not has_face then {say_sql('face')} end,
  case when not has_numbers then {say_sql('number')} end, case when power_urgency < 0.25 then {say_sql('urgency')} end, case when power_exclusivity < 0.25 then {say_sql('exclusivity')} end,
  case when readability < 60 then {say_sql('readability')} end, case when platform = 'tiktok' and not has_emoji then {say_sql('emoji')} end], lambda x: x is not null)"""


@query("r10_creative_recommendations", "creatives", f"select creative_id, array_to_string({ADVICE_SQL}[1:5], ' / ') as recommendations from ({PRED})")
def _(t):
    return R.predict(t.creatives).select("creative_id", F.array_join("recommendations", " / ").alias("recommendations"))


@query("r11_best_variant", "creatives", f"""
select ad_set_id, first(creative_id order by overall_quality_score desc, creative_id) as best_creative_id, max(overall_quality_score) as best_quality, count(*) as variants from ({QUALITY}) group by 1""")
def _(t):
    return R.best_variant(R.predict(t.creatives), "ad_set_id")


@query("r12_batch_scoring", "creatives", f"""
select creative_id, overall_quality_score, recommendations from ({QUALITY}) join (select creative_id, array_to_string({ADVICE_SQL}[1:3], ' / ') as recommendations from ({PRED})) using (creative_id)""")
def _(t):
    return R.batch_scoring(t.creatives).select("creative_id", "overall_quality_score", F.array_join("recommendations", " / ").alias("recommendations"))


# the weight of a text over the 100 most frequent terms, ties in the order of the terms
@query("r13_tfidf", "creatives", r"""
with words as (select creative_id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', headline, body)), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2)) as w from creatives),
  tf as (select creative_id, w, count(*) as n from words group by 1, 2),
  terms as (select w, sum(n) as total, count(*) as df from tf group by 1 order by total desc, w limit 100)
select creative_id, coalesce(sum(n * ln((select count(*) + 1 from creatives) / (df + 1)::double)), 0) as weight
from creatives left join (tf join terms using (w)) using (creative_id) group by 1""", r="weight", digits=3)
def _(t):
    weights = R.tfidf(t.creatives).groupBy("creative_id").agg(F.sum("weight").alias("weight"))
    return t.creatives.select("creative_id").join(weights, "creative_id", "left").select("creative_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


# click and conversion rate of creatives the models have not seen; the five inputs say little on few rows, so this asks that the error
# stays below 1.2 times that of the mean of the others
@query("r14_train_creative", "creatives", "select unnest(['ctr', 'cvr']) as model, count(*) as rows, true as bounded from creatives where quality is not null")
def _(t):
    rates = {"ctr": F.col("quality") * 0.02, "cvr": F.col("quality") * 0.01 + F.when(F.col("has_face"), 0.002).otherwise(0.0)}
    rows = staged(R.train_inputs(t.creatives.where("quality is not null")).select("creative_id", "quality", "has_face", *R.TRAIN_INPUTS), "inputs")
    parts = [beats_constant(R.rate_scores(rows, rate), of=1.2).withColumnRenamed("better", "bounded").withColumn("model", F.lit(m)) for m, rate in rates.items()]
    return parts[0].unionByName(parts[1])


@query("r15_comparable_creatives", "", """
with q as (select embedding::double[] as q from embeddings where vec_id = 7)
select vec_id, list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q))) as similarity
from embeddings, q where vec_id <> 7 order by similarity desc, vec_id limit 10""", r="similarity")
def _(t):
    e = t.raw("embeddings")
    mine = e.where("vec_id = 7").select("embedding").scalar()
    return R.comparable(e.where("vec_id <> 7"), mine, 10)


@query("r16_color_name", "", """
with p as (select p_partkey, (p_partkey * 37) % 256 as r, (p_partkey * 91) % 256 as g, (p_partkey * 153) % 256 as b from part)
select p_partkey, case when r > 200 and g < 100 and b < 100 then 'red' when r < 100 and g < 100 and b > 200 then 'blue' when r < 100 and g > 200 and b < 100 then 'green'
  when r > 200 and g > 200 and b < 100 then 'yellow' when r > 200 and g > 100 and b < 100 then 'orange' when r > 100 and g < 100 and b > 200 then 'purple'
  when r > 200 and g > 200 and b > 200 then 'white' when r < 50 and g < 50 and b < 50 then 'black' else 'neutral' end as color from p""")
def _(t):
    k = F.col("p_partkey")
    return t.raw("part").select("p_partkey", R.color_name((k * 37) % 256, (k * 91) % 256, (k * 153) % 256).alias("color"))


@query("r17_visual_score", "", """
select p_partkey, p_size / 50::double * 0.2 * 0.2 + (p_partkey % 10) / 10::double * 0.1 * 0.1 + (p_partkey % 7) / 7::double * 0.15 * 0.15 + (p_partkey % 9) / 9::double * 0.15 * 0.15
  + case when p_partkey % 2 = 0 then 1 else 0.5 end * 0.15 + 0.2 * 0.1 + case when p_partkey % 3 = 0 then 1 else 0.8 end * 0.15 as visual_score from part""", r="visual_score")
def _(t):
    k = F.col("p_partkey")
    f = t.raw("part").select(k, (F.col("p_size") / 50).alias("harmony"), ((k % 10) / 10).alias("contrast"), ((k % 7) / 7).alias("thirds"), ((k % 9) / 9).alias("balance"),
                             (k % 2 == 0).alias("product_visible"), (k % 3 == 0).alias("looking_at_camera"))
    return f.select("p_partkey", R.visual_score().alias("visual_score"))


@query("r18_hook_score", "", """
select p_partkey as creative_id, coalesce(s, 0.5::double) as hook_score from part left join (
  select l_partkey, avg(l_discount * 10 * 0.3 + l_tax * 10 * 0.3 + l_quantity / 50 * 0.4) as s from lineitem where l_orderkey % 120 < 90 group by 1) on l_partkey = p_partkey""", r="hook_score")
def _(t):
    frames = t.raw("lineitem").select(F.col("l_partkey").alias("creative_id"), (F.col("l_orderkey") % 120).alias("frame_no"), (F.col("l_discount") * 10).alias("brightness"),
                                      (F.col("l_tax") * 10).alias("contrast"), (F.col("l_quantity") / 50).alias("saturation"))
    return R.hook_score(frames, t.raw("part").select(F.col("p_partkey").alias("creative_id")))


def emotion_values():
    return ", ".join(f"('{k}', '{e}', {w}::double)" for k, emo in R.COLOR_EMOTIONS.items() for e, w in emo.items())


@query("r19_color_emotions", "creatives", f"""
select creative_id, emotion, avg(weight) as weight from ({COLOR_ROWS}) c join (values {emotion_values()}) e(color, emotion, weight) on e.color = c.color group by 1, 2""", r="weight")
def _(t):
    return R.color_emotions(creative_colors(t))


# ---- budgets -------------------------------------------------------------------------------

POST = "select campaign_id, sum(conversions) + 1 as alpha, sum(clicks) - sum(conversions) + 1 as beta from campaign_series group by 1"


@query("o01_posterior", "campaign_series", f"select campaign_id, alpha::double as alpha, beta::double as beta from ({POST})")
def _(t):
    return O.posterior(t.campaign_series)


SCORED_ALLOC = f"""select p.campaign_id, account_id, (alpha / (alpha + beta)::double) / sum(alpha / (alpha + beta)::double) over (partition by account_id) as allocation_score
  from ({POST}) p join campaigns using (campaign_id)"""


def allocation(t, method="mean"):
    return O.allocation_scores(O.posterior(t.campaign_series).join(t.campaigns.select("campaign_id", "account_id"), "campaign_id"), "account_id", method)


@query("o02_allocation_scores_mean", "campaign_series campaigns", SCORED_ALLOC, r="allocation_score")
def _(t):
    return allocation(t).select("campaign_id", "account_id", "allocation_score")


def beta_sql(alpha, beta, key):
    """The draw of budget.beta_draw: the first accepted of its tries."""
    def gamma(shape, part):
        d = f"({shape} - 1 / 3::double)"
        unit = lambda at: f"((('0x' || substr(h, {at}, 8))::ubigint + 0.5::double) / 4294967296::double)"
        x = f"(sqrt(-2 * ln({unit(1)})) * cos(2 * pi() * {unit(9)}))"
        v = f"pow({x} / sqrt({d} * 9) + 1, 3)"
        ok = f"{v} > 0 and ln({unit(17)}) < {x} * {x} * 0.5 + {d} - {d} * {v} + {d} * ln(greatest({v}, 1e-300))"
        tries = f"list_transform(range(1, {O.TRIES + 1}), lambda i: md5({key} || ':{part}:' || i))"
        return f"coalesce(list_filter(list_transform({tries}, lambda h: case when {ok} then {d} * {v} end), lambda g: g is not null)[1], {d})"
    return f"(select a / (a + b) from (select {gamma(alpha, 'a')} as a, {gamma(beta, 'b')} as b))"


SAMPLED = f"""select campaign_id, account_id, p / sum(p) over (partition by account_id) as allocation_score from (
  select campaign_id, account_id, {beta_sql("alpha", "beta", "'0:' || campaign_id || ':0'")} as p
  from (select campaign_id, alpha::double as alpha, beta::double as beta from ({POST})) join campaigns using (campaign_id))"""


@query("o02_allocation_scores_sampled", "campaign_series campaigns", SAMPLED, r="allocation_score")
def _(t):
    return allocation(t, "sample").select("campaign_id", "account_id", "allocation_score")


RULE = f"""select *, {rnd('nb', 2)} as recommended_budget, {rnd('case when current_budget > 0 then (nb - current_budget) / current_budget * 100 else 0 end', 1)} as change_pct,
  {rnd('cf * forecast_confidence', 2)} as confidence, roas_24h as predicted_roas from (
  select *, case k when 'pause' then 'pause' when 'low_keep' then 'maintain' when 'mid_keep' then 'maintain' when 'low_cut' then 'decrease' when 'mid_down' then 'decrease' else 'increase' end as action,
    case k when 'pause' then 0 when 'low_cut' then current_budget * 0.7 when 'high' then current_budget * least(allocation_score * 0.5 + 1.3, 2) when 'mid_up' then current_budget * (allocation_score * 0.3 + 1)
      when 'mid_down' then current_budget * 0.9 else current_budget end as nb,
    case k when 'pause' then 0.95 when 'low_keep' then 0.7 when 'low_cut' then 0.85 when 'high' then 0.9 else 0.75 end as cf,
    case k when 'pause' then printf('ROAS (%.2f) below pause threshold (0.5)', roas) when 'low_keep' then 'ROAS low but improving trend detected'
      when 'low_cut' then printf('ROAS (%.2f) below minimum threshold with %s trend', roas, trend) when 'high' then printf('High performer (ROAS %.2f), allocation score %.2f', roas, allocation_score)
      when 'mid_up' then printf('Above average allocation score (%.2f)', allocation_score) when 'mid_down' then printf('Below average allocation score (%.2f)', allocation_score)
      else 'Performance within expected range' end as reasoning from (
    select *, case when roas < 0.5 then 'pause' when roas < 1 and trend = 'improving' then 'low_keep' when roas < 1 then 'low_cut' when roas > 3 then 'high'
      when allocation_score > 0.3 then 'mid_up' when allocation_score < 0.1 then 'mid_down' else 'mid_keep' end as k
    from ({FORECAST}) f join ({SCORED_ALLOC}) a using (campaign_id, account_id)))"""


def rule_rows(t):
    return O.budget_rule(forecasts(t).join(allocation(t).select("campaign_id", "allocation_score"), "campaign_id"))


@query("o03_budget_rule", "campaign_state campaigns", f"""
select campaign_id, action, recommended_budget, change_pct, predicted_roas, confidence, reasoning from ({RULE})""")
def _(t):
    return rule_rows(t).select("campaign_id", "action", "recommended_budget", "change_pct", "predicted_roas", "confidence", "reasoning")


CONSTRAINED = f"""select campaign_id, account_id, action, current_budget, {rnd('case when s > 0 then recommended_budget * 1000 / s else recommended_budget end', 2)} as recommended_budget from (
  select *, sum(recommended_budget) over (partition by account_id) as s from ({RULE}))"""


def constrained(t):
    return O.constrain(rule_rows(t), "account_id", F.lit(1000.0))


@query("o04_budget_constraint", "campaign_state campaigns", f"select campaign_id, recommended_budget from ({CONSTRAINED})", r="recommended_budget", digits=2)
def _(t):
    return constrained(t).select("campaign_id", "recommended_budget")


@query("o05_expected_improvement", "campaign_state campaigns", f"""
select account_id, case when sum(recommended_budget) = 0 then 0 else sum(case action when 'increase' then recommended_budget * 0.15 when 'decrease' then recommended_budget * 0.05
  when 'pause' then current_budget * 0.2 else 0 end) / sum(recommended_budget) * 100 end as expected_improvement from ({RULE}) group by 1""", r="expected_improvement", digits=3)
def _(t):
    return O.expected_improvement(rule_rows(t), "account_id")


@query("a13_optimization_summary", "campaign_state campaigns", f"""
select count(*) as campaigns, count(*) filter (action <> 'maintain') as adjusted, sum(current_budget) as budget_before, sum(recommended_budget) as budget_after from ({RULE})""",
       r="budget_before budget_after", digits=2)
def _(t):
    return A.optimization_summary(rule_rows(t))


@query("o06_posterior_by_roas", "campaign_series", """
select campaign_id, count(*) filter (roas > 1) + 1::double as alpha, count(*) filter (roas <= 1) + 1::double as beta, count(*) as n, 1 / sqrt(count(*)) as exploration
from campaign_series group by 1""", r="exploration")
def _(t):
    return O.posterior_by_roas(t.campaign_series)


def thompson(t):
    post = O.posterior_by_roas(t.campaign_series).join(t.campaigns.select("campaign_id", "account_id"), "campaign_id")
    return O.thompson_shares(post, "account_id")


THOMPSON = f"""with post as (select campaign_id, account_id, count(*) filter (roas > 1) + 1::double as alpha, count(*) filter (roas <= 1) + 1::double as beta
    from campaign_series join campaigns using (campaign_id) group by campaign_id, account_id),
  drawn as (select campaign_id, account_id, draw, {beta_sql("alpha", "beta", "'0:' || campaign_id || ':' || draw")} as p from (select *, unnest(range(1, {O.DRAWS + 1})) as draw from post)),
  won as (select account_id, campaign_id, count(*) / {O.DRAWS}::double as share from (
    select account_id, draw, arg_max(campaign_id, (p, -campaign_id)) as campaign_id from drawn group by all) group by all),
  wishes as (select account_id, campaign_id, coalesce(share, 0) as share, greatest(10, coalesce(share, 0) * 1000) - 10 as wish,
    row_number() over w as pos, count(*) over (partition by account_id) as n from post left join won using (account_id, campaign_id) window w as (partition by account_id order by campaign_id)),
  frees as (select *, 1000 - n * 10 as slack, coalesce(sum(wish) over (partition by account_id order by pos rows between unbounded preceding and 1 preceding), 0) as wished from wishes),
  shorts as (select *, case when pos = 1 then slack when slack < 0 then 0 else greatest(0, slack - wished) end as short from frees)
select account_id, campaign_id, share, 1000::double as total, case when pos = n then short else least(wish, short) end + 10 as allocated_budget from shorts"""


@query("o07_thompson_allocate", "campaign_series campaigns", THOMPSON, r="share allocated_budget")
def _(t):
    return O.thompson_allocate(thompson(t), "account_id", F.lit(1000.0))


@query("o07_allocation_totals", "campaigns", "select account_id, count(*) as campaigns, 1000::double as allocated, true as floor_kept from campaigns group by 1", r="allocated", digits=3)
def _(t):
    rows = O.thompson_allocate(thompson(t), "account_id", F.lit(1000.0))
    return rows.groupBy("account_id").agg(F.count(F.lit(1)).alias("campaigns"), F.sum("allocated_budget").alias("allocated"),
                                          F.min(F.col("allocated_budget") >= 10 - 1e-9).alias("floor_kept"))


@query("o08_budget_rule_v2", "campaign_state", f"""
select campaign_id, case when roas_1h < 0.5 then 'pause' when roas_1h > 3 and roas > 2 then 'increase' when roas_1h < 1 then 'decrease' else 'maintain' end as action,
  case when roas_1h < 0.5 then 0 when roas_1h > 3 and roas > 2 then current_budget * 1.5 when roas_1h < 1 then greatest(current_budget * 0.75, 10) else current_budget end as recommended_budget,
  case when roas_1h < 0.5 then 0.9 when roas_1h > 3 and roas > 2 then 0.85 when roas_1h < 1 then 0.75 else 0.7 end::double as confidence from ({FORECAST})""", r="recommended_budget")
def _(t):
    return O.budget_rule_v2(forecasts(t)).select("campaign_id", "action", "recommended_budget", "confidence")


@query("o09_action_log", "campaign_state campaigns", f"""
select campaign_id, action as action_type, reasoning as reason, confidence, (campaign_id % 3) * 1.0::double > roas as success from ({RULE}) where action <> 'maintain'""")
def _(t):
    later = t.campaigns.select("campaign_id", ((F.col("campaign_id") % 3) * 1.0).alias("roas"))
    return O.action_log(rule_rows(t), AS_OF_ORDERS, later).select("campaign_id", "action_type", "reason", "confidence", "success")


@query("o10_material_changes", "campaign_state campaigns", f"select campaign_id, change_pct from ({RULE}) where abs(change_pct) >= 10")
def _(t):
    return O.material_changes(rule_rows(t)).select("campaign_id", "change_pct")


@query("o11_bounded_change", "campaign_state campaigns", f"""
select campaign_id, case when w = 0 then 0 else greatest(10, current_budget * 0.5, least(w, current_budget * 2)) end as bounded_budget
from (select campaign_id, current_budget, recommended_budget * 2.2::double as w from ({RULE}))""", r="bounded_budget")
def _(t):
    return rule_rows(t).select("campaign_id", O.bounded_change(F.col("current_budget"), F.col("recommended_budget") * 2.2).alias("bounded_budget"))


# steps held out per campaign, and that the model's error over all of them is below that of repeating the last value
@query("o12_train_roas_forecaster", "ad_metrics", """
select campaign_id, count(*) as steps, true as better from (
  select campaign_id, day, row_number() over w as pos, count(*) over (partition by campaign_id) as n from ad_metrics window w as (partition by campaign_id order by day))
where pos > 3 and pos < n and day >= date '2000-01-01' group by 1""")
def _(t):
    rows = O.forecaster_rows(t.ad_metrics, t.campaigns, 1)
    _, scored = O.train_forecaster(rows, "2000-01-01")
    scored = staged(scored.select("campaign_id", "prediction", "target", "roas"), "forecasts")
    error = lambda x: F.sum(F.abs(F.col(x) - F.col("target")))
    better = scored.agg(error("prediction") < error("roas")).scalar()
    return scored.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("steps")).withColumn("better", better)


# ---- alerts --------------------------------------------------------------------------------

CTX = "select event_id, ts, user_id, value / 300 as churn_probability, case when event_type = 'error' then -value / 500 end as roas_change, value % 101 as budget_remaining_percent, (value % 17) / 80 as drift_score from events"
TRIG = f"""with c as ({CTX})
select event_id, ts, user_id, churn_probability, 'churn_critical' as rule_id, 'critical' as severity, 240 as cooldown_minutes from c where churn_probability >= 0.8
union all select event_id, ts, user_id, churn_probability, 'churn_high', 'high', 1440 from c where churn_probability >= 0.6 and churn_probability < 0.8
union all select event_id, ts, user_id, churn_probability, 'roas_drop', 'high', 60 from c where coalesce(roas_change, 0) < -0.3
union all select event_id, ts, user_id, churn_probability, 'budget_depleted', 'medium', 60 from c where budget_remaining_percent < 10
union all select event_id, ts, user_id, churn_probability, 'model_drift', 'high', 1440 from c where drift_score > 0.15"""


def contexts(t):
    v = F.col("value")
    return t.raw("events").select(
        "event_id", "ts", "user_id", (v / 300).alias("churn_probability"), F.when(F.col("event_type") == "error", -v / 500).alias("roas_change"),
        (v % 101).alias("budget_remaining_percent"), ((v % 17) / 80).alias("drift_score"))


@query("l01_evaluate_rules", "", f"select event_id, rule_id, severity, cooldown_minutes from ({TRIG})")
def _(t):
    return L.evaluate_rules(contexts(t)).select("event_id", "rule_id", "severity", "cooldown_minutes")


@query("l01_evaluate_rules_filtered", "", f"select event_id, rule_id from ({TRIG}) where rule_id = 'churn_high'")
def _(t):
    return L.evaluate_rules(contexts(t), L.toggled(L.default_rules(), "churn_critical", False), "churn_risk").select("event_id", "rule_id")


def cooldown_sql(keys):
    on = " and ".join(f"x.{k} = f.{k}" for k in keys)
    ks = ", ".join(keys)
    return f"""with recursive trig as materialized ({TRIG}),
  f as (select {ks}, min(ts) as ts, max(cooldown_minutes) as m from trig group by {ks}
    union all select * from (select {', '.join('f.' + k for k in keys)}, (select min(x.ts) from trig x where {on} and x.ts >= f.ts + f.m * interval 1 minute) as ts, f.m from f) where ts is not null)
select {', '.join('t.' + k for k in keys)}, min(t.event_id) as event_id from trig t join f on {' and '.join(f't.{k} = f.{k}' for k in keys)} and t.ts = f.ts group by {', '.join('t.' + k for k in keys)}, t.ts"""


@query("l02_cooldown_rule_scope", "", cooldown_sql(["rule_id"]))
def _(t):
    return L.cooldown(L.evaluate_rules(contexts(t)), ["rule_id"], tie="event_id").select("rule_id", "event_id")


@query("l02_cooldown_entity_scope", "", cooldown_sql(["rule_id", "user_id"]))
def _(t):
    return L.cooldown(L.evaluate_rules(contexts(t)), ["rule_id", "user_id"], tie="event_id").select("rule_id", "user_id", "event_id")


@query("l03_render_alert", "scored factors", """
select s.client_id, rule_id, 'Churn Risk: ' || client_name as title, case when rf is null then '{}' else printf('Client %s has %.0f%% churn probability. Risk factors: %s', client_name, churn_probability * 100, rf) end as message
from (select *, case when churn_probability >= 0.8 then 'churn_critical' else 'churn_high' end as rule_id from scored where churn_probability >= 0.6) s
left join (select client_id, string_agg(factor, ', ' order by pos) as rf from factors group by 1) f on f.client_id = s.client_id""")
def _(t):
    ctx = t.scored.select("client_id", "client_name", "churn_probability", F.array_join(F.transform("risk_factors", lambda x: x["factor"]), ", ").alias("risk_factors"))
    return L.render(L.evaluate_rules(ctx)).select("client_id", "rule_id", "title", "message")


@query("l04_alert_state", "alerts", """
with a as (select o_orderkey % 4000 as alert_id, case when o_orderstatus = 'F' then 'resolve' else 'acknowledge' end as action, o_orderdate::date + (o_orderkey % 1000)::int as done_on from orders)
select alert_id, max(case when action = 'acknowledge' then done_on end) as acknowledged_at, max(case when action = 'resolve' then done_on end) as resolved_at from alerts left join a using (alert_id) group by 1""".replace("from alerts left join a", "from (select alert_id from alerts) left join a"))
def _(t):
    k = F.col("o_orderkey")
    actions = t.raw("orders").select((k % 4000).alias("alert_id"), F.when(F.col("o_orderstatus") == "F", "resolve").otherwise("acknowledge").alias("action"),
                                     F.date_add(F.col("o_orderdate").cast("date"), (k % 1000).cast("int")).alias("at"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"))
    return L.alert_state(t.alerts.select("alert_id"), actions).drop("acknowledged_by")


CONTEXT = """select client_id, client_name, overall_score as health_score, churn_probability, actual_roas as roas, target_roas, monthly_spend, days_since_contact as last_contact_days,
  engagement_score, case when client_id % 6 = 0 then null when client_id % 5 = 0 then 0 else contract_months_remaining * 20 end as contract_end_days from scored"""


def client_context(t):
    k = F.col("client_id")
    return t.scored.select(
        "client_id", "client_name", F.col("overall_score").alias("health_score"), "churn_probability", F.col("actual_roas").alias("roas"), "target_roas", "monthly_spend",
        F.col("days_since_contact").alias("last_contact_days"), "engagement_score",
        F.when(k % 6 == 0, F.lit(None)).when(k % 5 == 0, 0).otherwise(F.col("contract_months_remaining") * 20).alias("contract_end_days"))


def template_sql():
    rows = []
    for name, (kind, title, _, _, impact, due) in L.TEMPLATES.items():
        tot = sum(abs(v) for v in impact.values())
        i = lambda k: impact.get(k, 0.0)  # noqa: E731, B023
        rows.append(f"('{name}', '{kind}', '{title}', {tot}::double, {due}, {i('health_score')}::double, {i('churn_probability')}::double, {i('roas')}::double)")
    return f"(values {', '.join(rows)}) tp(template, type, title, impact, due_days, dh, dp, dr)"


INTERVENTIONS = f"""with x as ({CONTEXT}),
 cand as (
  select *, 1 as i, 'executive_outreach' as template, 'immediate' as priority, 0.92 as confidence from x where churn_probability >= 0.7
  union all select *, 2, 'manager_escalation', 'immediate', 0.88 from x where churn_probability >= 0.7
  union all select *, 3, 'retention_discount', 'high', 0.75 from x where churn_probability >= 0.7 and monthly_spend > 10000
  union all select *, 4, 'executive_outreach', 'high', 0.85 from x where churn_probability < 0.7 and churn_probability >= 0.5
  union all select *, 5, 'performance_optimization', 'high', 0.90 from x where roas < target_roas * 0.8
  union all select *, 6, 'quick_win_campaign', 'high', 0.82 from x where roas < target_roas * 0.5
  union all select *, 7, 'training_session', 'medium', 0.78 from x where engagement_score < 40
  union all select *, 8, 'executive_outreach', 'medium', 0.72 from x where last_contact_days > 14 and health_score < 60
  union all select *, 9, 'executive_outreach', 'high', 0.88 from x where contract_end_days <> 0 and contract_end_days < 30
  union all select *, 10, 'reactivation_campaign', 'medium', 0.65 from x where last_contact_days > 30 and health_score < 30),
 uniq as (select c.*, type, title, impact, due_days, dh, dp, dr, case priority when 'immediate' then 4 when 'high' then 3 else 2 end as pr from cand c join {template_sql()} on tp.template = c.template
  qualify row_number() over (partition by client_id, type, title order by i) = 1),
 best as (select *, pr * 2 + impact * 0.5 + confidence::double * 3 as rank_score from uniq),
 ranked as (select *, row_number() over (partition by client_id order by rank_score desc, i) as position from best)
"""


@query("l05_interventions", "scored", INTERVENTIONS + "select client_id, position, type, title, priority, confidence::double as confidence, due_days, rank_score from ranked where position <= 5", r="rank_score")
def _(t):
    rows = L.interventions(client_context(t))
    return rows.select("client_id", F.col("position").cast("bigint").alias("position"), "type", "title", "priority", "confidence", "due_days", "rank_score")


@query("l06_channel", "scored", INTERVENTIONS + """
select client_id, position, case when monthly_spend > 20000 then case when type in ('outreach', 'escalation') then 'meeting' else 'phone' end when churn_probability > 0.7 then 'phone'
  when type = 'training' then 'meeting' else 'email' end as channel from ranked where position <= 5""")
def _(t):
    return L.interventions(client_context(t)).select("client_id", F.col("position").cast("bigint").alias("position"), "channel")


@query("l07_intervention_impact", "scored", INTERVENTIONS + """
select client_id, any_value(health_score) as current_health_score, least(100, any_value(health_score) + sum(dh)) as predicted_health_score,
  any_value(churn_probability) as current_churn_probability, greatest(0, any_value(churn_probability) + sum(dp)) as predicted_churn_probability,
  any_value(roas) as current_roas, any_value(roas) + sum(dr) as predicted_roas, count(*) as interventions_count,
  sum(case pr when 4 then 4 when 3 then 3 else 2 end)::bigint as estimated_effort_hours from ranked where position <= 5 group by 1""",
       r="predicted_health_score predicted_churn_probability predicted_roas")
def _(t):
    return L.intervention_impact(L.interventions(client_context(t)))


TRACKED = """select (['outreach','discount','training'])[o_orderkey % 3 + 1] as type, case when o_orderstatus = 'F' then 'completed' else 'in_progress' end as status,
  o_orderkey % 4 = 0 as churn_prevented, case when o_orderkey % 5 = 0 then true when o_orderkey % 5 = 1 then false end as health_improved, o_orderkey % 30 as days from orders"""


def tracked(t):
    k = F.col("o_orderkey")
    start = F.col("o_orderdate")
    return t.raw("orders").select(
        pick(["outreach", "discount", "training"], k % 3).alias("type"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress").alias("status"),
        (k % 4 == 0).alias("churn_prevented"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("health_improved"), start.alias("created_at"),
        (start + F.make_dt_interval((k % 30).cast("int"), F.lit(5))).alias("completed_at"))


@query("l08_effectiveness", "", f"""
select count(*) as sample_size, avg((churn_prevented or coalesce(health_improved, false))::int) as success_rate, avg(days) as avg_completion_days
from ({TRACKED}) where status = 'completed' and type = 'outreach'""", r="success_rate avg_completion_days")
def _(t):
    return L.effectiveness(tracked(t), "outreach")


@query("l09_dashboard_alerts", "scored campaign_state", """
select part, id, type, message, time from (
  select 0 as part, client_id as id, 'warning' as type, printf('Client "%s" health score dropped to %d', client_name, trunc(overall_score)::bigint) as message,
    printf('%d days to potential churn', days_to_churn) as time from scored where risk_level in ('critical', 'warning')
  union all select 1, campaign_id, 'success', printf('Campaign "%s" ROAS increased to %.1fx', campaign_name, roas), 'Real-time' from campaign_state where roas > 10)
order by part, id limit 5""")
def _(t):
    return L.dashboard_alerts(t.scored, t.campaign_state)


# ---- monitoring ----------------------------------------------------------------------------

ERRORS = f"select model, avg(abs(prediction - actual)) as mae, avg((prediction - actual) ** 2) as mse, count(*) as samples, sqrt(avg((prediction - actual) ** 2)) as rmse from ({MATCHED}) group by 1"


@query("m01_error_metrics", "predictions actuals", ERRORS, r="mae mse rmse", digits=6)
def _(t):
    return M.error_metrics(t.predictions, t.actuals)


@query("m02_any_drift", "predictions", f"select coalesce(bool_or(drift_detected), false) as any_drift, count(*) filter (drift_detected) as models_drifted from ({DRIFT})")
def _(t):
    return M.any_drift(t.predictions)


@query("m03_assign_variant", "", """
select distinct user_id, case when (('0x' || substr(md5('t9:' || user_id), 1, 8))::bigint % 10000) / 10000 < 0.3 and user_id % 10 <> 3 then 'treatment' else 'control' end as variant from events""")
def _(t):
    users = t.raw("events").select("user_id").distinct()
    return users.select("user_id", M.assign_variant(F.col("user_id"), F.lit("t9"), 0.3, F.col("user_id") % 10 != 3).alias("variant"))


AB = """with g as (select test_id, avg(value) filter (variant = 'control') as control_mean, avg(value) filter (variant = 'treatment') as treatment_mean,
  count(*) filter (variant = 'control') as control_samples, count(*) filter (variant = 'treatment') as treatment_samples,
  var_pop(value) filter (variant = 'control') as vc, var_pop(value) filter (variant = 'treatment') as vt from ({src}) group by 1),
  z as (select *, (treatment_mean - control_mean) / (control_mean + 1e-6) as lift, abs(treatment_mean - control_mean) / ({spread} + 1e-6) as z_score from g)
select test_id, control_mean, treatment_mean, lift, lift * 100 as lift_percent, z_score, z_score > 1.96 as significant, control_samples, treatment_samples,
  case when z_score > 1.96 and lift > 0 then 'treatment' when z_score > 1.96 and lift < 0 then 'control' when z_score is not null then 'inconclusive' end as winner,
  case when control_samples = 0 or treatment_samples = 0 then 'Insufficient data' end as error from z"""
AB_COLS = "control_mean treatment_mean lift lift_percent z_score"
AB_SRC = "select * from ab_outcomes union all select 't2', user_id, 'control', metric, value from ab_outcomes where variant = 'control'"


def outcomes(t):
    return t.ab_outcomes.unionByName(t.ab_outcomes.where("variant = 'control'").withColumn("test_id", F.lit("t2")))


@query("m04_ab_analysis", "ab_outcomes", AB.format(spread="sqrt((vc + vt) / 2)", src=AB_SRC), r=AB_COLS)
def _(t):
    return M.ab_analysis(outcomes(t))


@query("m05_ab_analysis_welch", "ab_outcomes", AB.format(spread="sqrt(vc / nullif(control_samples, 0) + vt / nullif(treatment_samples, 0))", src=AB_SRC), r=AB_COLS)
def _(t):
    return M.ab_analysis(outcomes(t), method="welch")


@query("m06_should_retrain", "predictions actuals", f"""
select m.model, case when drift_detected then 'drift_detected' when m.model % 2 = 0 and 40 > 30 then 'scheduled' when rmse > 0.5 then 'performance_degradation' else 'no_action_needed' end as reason,
  drift_detected or m.model % 2 = 0 or rmse > 0.5 as retrain
from (select distinct model from predictions) m left join ({DRIFT}) d on d.model = m.model left join ({ERRORS}) e on e.model = m.model""")
def _(t):
    models = t.predictions.select("model").distinct()
    k = F.col("model")
    schedule = models.select(k, F.lit(30).alias("interval_days"), F.date_sub(F.lit(AS_OF_ORDERS).cast("date"), F.when(k % 2 == 0, 40).otherwise(10)).alias("last_retrain"))
    return M.should_retrain(models, W.drift(t.predictions), M.error_metrics(t.predictions, t.actuals), schedule, AS_OF_ORDERS)
