"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import (decontaminate, exact_search, jaccard_join, language, lm_score, minhash, packing, quality, resample, secret_scan, sharding, spelling,
                           token_store)
from spendlens.llm.common import remainder, table
from spendlens.session import shared_scratch, staged


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = staged(lm_score.word_ids(table(spark, sf_dir, "documents")), "word-ids")
    return lm_score.score_ids(words, lm_score.fit_ids(words))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language.fit_language(docs.where(remainder("doc_id", 4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    scored = quality.score_quality(stats, quality.fit_quality(stats, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), percent=80, width=5)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.fit_markov(docs))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(secret_scan.written("base"), 256).alias("base_sha256"), secret_scan.written("spans").alias("spans"))


def op7_token_store(spark: SparkSession, sf_dir: str, vocabulary: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    path = shared_scratch(spark, "token-files")
    token_store.write_texts(table(spark, sf_dir, "documents"), vocabulary, 2, path)
    return token_store.read_ids(spark, path)


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, end_id=0, capacity=1024)


def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(exact_search.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024))
    return exact_search.top_products(rows.select("vec_id", whole.alias("v")), "vec_id % 100 = 0", k=10)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, seed=7)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=80, width=4)


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_secrets": op6_secrets,
    "op7_token_store": op7_token_store,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_exact_search": op10_exact_search,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_target_resample": op12_target_resample,
    "op13_minhash_dedup": op13_minhash_dedup,
}
# CRC-32 in SQL: its table by rule, and a fold over the bytes of a text's hexadecimal form
CRC_TABLE = """poly as (select b, b::uinteger as v, 0 as i from range(256) x(b)
    union all select b, case when v & 1 = 1 then xor(v >> 1, 3988292384::uinteger) else v >> 1 end, i + 1 from poly where i < 8),
tab as materialized (select list(v order by b) as t from poly where i = 8)"""
CRC = """xor(list_reduce(list_prepend(4294967295::uinteger, list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, (2 * i + 1)::bigint, 2))::uinteger)),
        lambda s, b: xor(s >> 8, tab.t[xor(s & 255, b) + 1])), 4294967295::uinteger)"""
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def linked_sql(width: int, columns: str) -> str:
    """Distinct shingles of ``width`` words, links at 80 % of the union, and the least document reachable."""
    return f"""
with recursive split as (select doc_id, coalesce(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
sets as materialized (
    select distinct doc_id, unnest(case when len(w) >= {width} then list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from split),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
overlap as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b using (s) where a.doc_id < b.doc_id group by all),
links as materialized (
    select a, b from overlap join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
either as materialized (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, either.b from reach join either on reach.r = either.a),
least as (select doc_id, min(r) as component_id from reach group by doc_id)
select {columns} from least left join sizes using (doc_id)
"""


ORACLE: dict[str, str] = {
    "op5_jaccard_join": linked_sql(5, "doc_id, coalesce(n, 0) as n_shingles, component_id"),
    "op13_minhash_dedup": linked_sql(4, "doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept"),
    "op10_exact_search": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op11_spelling_variants": f"""
with recursive {CRC_TABLE},
runs as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents)
    where length(run) >= 5 group by all),
hashed as (select run, c, {CRC} as h from (select *, hex(encode(doc_id::varchar || ':' || run)) as hx from runs), tab),
words as materialized (
    select word, sum(c)::bigint as n from (
        select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run) + 2)::bigint) else run end as word, c from hashed)
    where length(word) >= 5 group by word having sum(c) >= 3),
holes as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select *, unnest(range(0, length(word))) as i from words)),
near as materialized (
    select a.word, b.word as other, b.n as m from holes a join holes b on a.i = b.i and a.rest = b.rest and length(a.word) = length(b.word) and a.word <> b.word
    union select h.word, w.word, w.n from holes h join words w on h.rest = w.word
    union select w.word, h.word, h.n from holes h join words w on h.rest = w.word),
best as (select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, other)) as other from near group by word),
formed as materialized (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when b.m >= 2 * w.n then b.other end as form, case when b.m >= 2 * w.n then b.m end as form_n
    from words w left join best b using (word)),
chain as (select word, form as at from formed where form is not null
    union all select chain.word, f.form from chain join formed f on chain.at = f.word where f.form is not null),
ends as (select chain.word, chain.at as root from chain join formed f on chain.at = f.word where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from formed left join ends using (word)
""",
    "op12_target_resample": f"""
with recursive {CRC_TABLE},
texts as (select 'd' as side, doc_id, {LOWER} as t from documents union all select 'b', item_id, {LOWER} from benchmark),
split as (select side, doc_id, coalesce(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from texts),
features as (
    select side, doc_id, unnest(w || list_transform(range(1, length(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from split),
counted as materialized (select side, doc_id, f, count(*) as c from features group by all),
bucket as materialized (select f, {CRC} % 10000 as b from (select distinct f, hex(encode(f)) as hx from counted), tab),
total as (select b, sum(c) filter (side = 'd') as s, sum(c) filter (side = 'b') as t from counted join bucket using (f) group by b),
gain as materialized (select b, floor(1000 * ln((coalesce(total.t, 0) + 1)::double * (a.s + 10000)::double / ((coalesce(total.s, 0) + 1)::double * (a.t + 10000)::double)))::bigint as g
    from total, (select coalesce(sum(c) filter (side = 'd'), 0) as s, coalesce(sum(c) filter (side = 'b'), 0) as t from counted) a),
weights as (select doc_id, sum(c)::bigint as n_features, floor(sum(c * g)::double / sum(c))::bigint as weight
    from counted join bucket using (f) join gain using (b) where side = 'd' group by doc_id),
scored as (
    select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::ubigint + 0.5::double) / 4294967296::double)))::bigint as score
    from (select doc_id from documents) left join weights using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as p, count(*) over () as n from scored where n_features >= 39)
select doc_id, n_features, weight, score, case when p <= 25 * n // 100 then p end as rank from scored left join placed using (doc_id)
""",
}
