"""Queries of vector search and of result handling.

Searches take every row whose id is divisible by 50 as queries, against all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.operators import evaluate, search
from lodeweave.plans import data_queries
from lodeweave.plans.filter_dsl import Filter, compile_filters
from lodeweave.plans.registry import query
from lodeweave.runtime import table

K, EVERY = 10, 50

_CHUNKS = """chunks as (
  select id, first(vector)::double[] as vector, first(asset_id) as asset_id, first(asset_version) as asset_version, first(asset_type) as asset_type
  from chunk_vectors
  where id is not null and len(vector) = 64 and len(list_filter(vector, lambda x: x is null)) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0
  group by id)"""
_SIM = "round(list_cosine_similarity(q.vector, c.vector), 9)"


def _chunks(spark, d):
    return search.usable_chunks(table(spark, d, "chunk_vectors"))


def _asked(chunks):
    return chunks.where(F.col("id") % EVERY == 0).dropDuplicates(["id"]).withColumnRenamed("id", "query_id")


def _once(spark, d):
    return search.distinct_chunks(table(spark, d, "chunk_vectors"))


def _embeddings(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("asset_id"))
    return e, e.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector", F.col("asset_id").alias("label"))


_EMBEDDED = f"""scored as (
  select q.vec_id as query_id, c.vec_id as id, c.label, q.label as own, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as sim
  from embeddings q, embeddings c where q.vec_id % {EVERY} = 0),
ranked as (select *, row_number() over (partition by query_id order by sim desc, id) as rank from scored)"""
_TOPK = f"with {_EMBEDDED} select query_id, cast(rank as int) as rank, id, round(1 - sim, 6) as distance from ranked where rank <= {K}"


@query(_TOPK)
def vector_topk(spark, d):
    corpus, asked = _embeddings(spark, d)
    return search.top_k(asked, corpus, K).select("query_id", "rank", "id", "distance")


@query(_TOPK)
def vector_topk_expression(spark, d):
    corpus, asked = _embeddings(spark, d)
    return search.top_k_expression(asked, corpus, K).select("query_id", "rank", "id", "distance")


@query(f"""with {_CHUNKS}, scored as (select q.id as query_id, c.id, {_SIM} as sim from chunks q, chunks c where q.id % {EVERY} = 0),
ranked as (select *, row_number() over (partition by query_id order by sim desc, id) as rank from scored)
select query_id, cast(rank as int) as rank, id, round(1 - sim, 6) as distance from ranked where rank <= {K}""")
def vector_topk_batch(spark, d):
    chunks = _chunks(spark, d)
    return search.top_k(_asked(chunks), chunks, K).select("query_id", "rank", "id", "distance")


def _grouped_sql(queries: str, corpus: str = "chunks", where: str = "true", k: int = K, extra: str = "") -> str:
    return f"""with {_CHUNKS}{extra}, best as (
  select q.query_id, c.asset_id, max({_SIM}) as sim from ({queries}) q, {corpus} c where c.asset_id is not null and {where} group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by sim desc, asset_id) as rank from best)
select query_id, cast(rank as int) as rank, asset_id, round(1 - sim, 6) as distance from ranked where rank <= {k}"""


_Q = f"select id as query_id, vector, asset_type from chunks where id % {EVERY} = 0"
_SEEDS = f"select asset_id as query_id, vector, asset_type from chunks where asset_id in (select asset_id from chunks where id % {EVERY} = 0)"


@query(_grouped_sql(_Q))
def grouped_topk(spark, d):
    chunks = _chunks(spark, d)
    return search.grouped_top_k(_asked(chunks), chunks, K)


@query(_grouped_sql(_SEEDS))
def multi_vector_topk(spark, d):
    chunks = _chunks(spark, d)
    seeds = _asked(chunks).select("asset_id").where("asset_id is not null")
    return search.recommend(seeds, chunks, K, same_type=False)


@query(_grouped_sql(_SEEDS, where="c.asset_type = q.asset_type and c.asset_id <> q.query_id"))
def recommend_same_type(spark, d):
    chunks = _chunks(spark, d)
    return search.recommend(_asked(chunks).select("asset_id").where("asset_id is not null"), chunks, K, same_type=True)


@query(_grouped_sql(_SEEDS, where="c.asset_type = 'publications'"))
def recommend_cross_type(spark, d):
    chunks = _chunks(spark, d)
    seeds = _asked(chunks).select("asset_id").where("asset_id is not null").distinct()
    asked = chunks.join(seeds, "asset_id", "left_semi").select(F.col("asset_id").alias("query_id"), "vector")
    return search.grouped_top_k(asked, chunks.where("asset_type = 'publications'"), K)


@query(f"""with {_CHUNKS}, best as (
  select q.id as query_id, c.asset_id, c.asset_type, max({_SIM}) as sim from chunks q, chunks c where q.id % {EVERY} = 0 and c.asset_id is not null and c.asset_type is not null group by 1, 2, 3),
per as (select *, row_number() over (partition by query_id, asset_type order by sim desc, asset_id) as r from best),
ranked as (select *, row_number() over (partition by query_id order by sim desc, asset_id, asset_type) as rank from per where r <= {K})
select query_id, cast(rank as int) as rank, asset_id, asset_type, round(1 - sim, 6) as distance from ranked where rank <= {K}""")
def fanout_merge_topk(spark, d):
    chunks = _chunks(spark, d)
    return search.fan_out(_asked(chunks), chunks, K)


def _described(spark, d):
    """Assets fit to be shown: with a name and a description."""
    a = table(spark, d, "assets")
    return a.where(F.col("name").isNotNull() & tx.text_of(F.col("description")).isNotNull()).select(F.col("identifier").alias("asset_id")).distinct()


_KNOWN = "(select identifier from assets where name is not null and (description.plain is not null or description.html is not null))"


@query(_grouped_sql(_Q, where=f"c.asset_id in {_KNOWN}"))
def validated_search(spark, d):
    chunks = _chunks(spark, d)
    return search.validated(_asked(chunks), chunks, _described(spark, d), K)


def _rounds_sql(rounds: int = 5) -> str:
    """Each round looks at so many further hits as valid ones are missing; what a round reaches follows from the round before."""
    seen = "".join(f""", r{i} as (select p.query_id, greatest(p.reach, {K} + count(*) filter (where not h.ok and h.rank <= p.reach)) as reach
  from r{i - 1} p join hits h using (query_id) group by p.query_id, p.reach)""" for i in range(1, rounds))
    return f"""with {_CHUNKS}, best as (select q.id as query_id, c.asset_id, max({_SIM}) as sim from chunks q, chunks c where q.id % {EVERY} = 0 and c.asset_id is not null group by 1, 2),
hits as (select query_id, asset_id, round(1 - sim, 6) as distance, coalesce(asset_id in {_KNOWN}, false) as ok, row_number() over (partition by query_id order by sim desc, asset_id) as rank from best qualify rank <= {K * rounds}),
r0 as (select distinct query_id, {K} as reach from hits){seen},
kept as (select h.query_id, h.asset_id, h.distance, row_number() over (partition by h.query_id order by h.rank) as rank from hits h join r{rounds - 1} using (query_id) where h.ok and h.rank <= reach)
select query_id, cast(rank as int) as rank, asset_id, distance from kept where rank <= {K}"""


@query(_rounds_sql())
def validated_search_rounds(spark, d):
    chunks = _chunks(spark, d)
    return search.validated_rounds(_asked(chunks), chunks, _described(spark, d), K)


@query(f"with hits as ({_grouped_sql(_Q)}) select distinct asset_id from hits where asset_id not in {_KNOWN}")
def lazy_delete_candidates(spark, d):
    chunks = _chunks(spark, d)
    return search.lazy_deletes(_asked(chunks), chunks, _described(spark, d), K)


_LOGGED = f"select distinct query_id, vector_id, asset_ids from search_results where vector_id % {EVERY} = 0"


@query(_grouped_sql(f"select l.query_id, c.vector from ({_LOGGED}) l join chunks c on c.id = l.vector_id", extra=f", banned as (select query_id, unnest(asset_ids) as asset_id from ({_LOGGED}) where asset_ids is not null)", where="not exists (select 1 from banned b where b.query_id = q.query_id and b.asset_id = c.asset_id)"))
def exclude_ids_topk(spark, d):
    chunks = _chunks(spark, d)
    log = table(spark, d, "search_results").where(F.col("vector_id") % EVERY == 0).select("query_id", "vector_id", "asset_ids").distinct()
    asked = log.join(chunks.where(F.col("id") % EVERY == 0).select(F.col("id").alias("vector_id"), "vector").dropDuplicates(["vector_id"]), "vector_id").select("query_id", "vector")
    banned = log.select("query_id", F.explode("asset_ids").alias("asset_id"))
    most = banned.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0  # a result list has at most 100 entries
    return search.excluding(asked, chunks, banned, K, most)


@query(f"""with {_CHUNKS}, scored as (select q.id as query_id, c.id, c.asset_id, {_SIM} as sim from chunks q, chunks c where q.id % {EVERY} = 0 and c.asset_id is not null),
wide as (select *, row_number() over (partition by query_id order by sim desc, id) as r from scored),
firsts as (select query_id, asset_id, min(r) as f, round(1 - max(sim), 6) as distance from wide where r <= {K * 10} group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by f) as rank from firsts)
select query_id, cast(rank as int) as rank, asset_id, distance from ranked where rank <= {K}""")
def overfetch_dedup_topk(spark, d):
    chunks = _chunks(spark, d)
    return search.overfetch(_asked(chunks), chunks, K)


@query(_grouped_sql(_Q, where="c.asset_type = q.asset_type"))
def per_query_filter_topk(spark, d):
    chunks = _chunks(spark, d).where("asset_type is not null").withColumn("tag", F.col("asset_type"))
    return search.grouped_top_k(_asked(chunks), chunks, K, tagged=True)


_FITS = {
    0: "m.datapoints_lower_bound >= 1000",
    1: "list_contains(list_transform(m.languages, lambda x: lower(x)), 'en') and m.datapoints_upper_bound < 1000000",
    2: "(lower(m.license) = 'olc-by-4.0' or lower(m.license) = 'olc-by-3.0')",
}
_ALLOWED = ", allowed as (" + " union ".join(f"select distinct {n} as tag, m.asset_id from dataset_metadata m where {c}" for n, c in _FITS.items()) + ")"


@query(_grouped_sql(f"select id as query_id, vector, id // {EVERY} % 3 as tag from chunks where id % {EVERY} = 0", extra=_ALLOWED, where="exists (select 1 from allowed w where w.tag = q.tag and w.asset_id = c.asset_id)"))
def per_query_conditions_topk(spark, d):
    chunks, filters = _chunks(spark, d), data_queries.METADATA
    of = lambda *f: compile_filters([Filter.parse(x) for x in f], filters)
    expr = lambda op, value: {"comparison_operator": op, "value": value}
    conditions = {
        0: of({"field": "datapoints_lower_bound", "expressions": [expr(">=", 1000)]}),
        1: of({"field": "languages", "expressions": [expr("==", "en")]}, {"field": "datapoints_upper_bound", "expressions": [expr("<", 1000000)]}),
        2: of({"field": "license", "logical_operator": "OR", "expressions": [expr("==", "olc-by-4.0"), expr("==", "olc-by-3.0")]}),
    }
    asked = _asked(chunks).withColumn("tag", F.floor(F.col("query_id") / EVERY).cast("int") % 3)
    return search.conditioned(asked, chunks, table(spark, d, "dataset_metadata"), conditions, K)


@query(_grouped_sql(_Q, where="c.asset_version >= 2 and c.asset_type in ('datasets', 'ml_models')"))
def filtered_topk(spark, d):
    chunks = _chunks(spark, d)
    kept = chunks.where((F.col("asset_version") >= 2) & F.col("asset_type").isin("datasets", "ml_models"))
    return search.grouped_top_k(_asked(chunks), kept, K)


@query(f"with {_CHUNKS} select asset_id, count(*) as chunks, min(id) as first_chunk, round(sum(vector[1]), 5) as first_component from chunks where asset_id is not null group by asset_id")
def asset_vectors(spark, d):
    c = _once(spark, d).where("asset_id is not null")
    return c.groupBy("asset_id").agg(F.count("*").alias("chunks"), F.min("id").alias("first_chunk"), F.round(F.sum(F.col("vector")[0].cast("double")), 5).alias("first_component"))


@query("select distinct asset_id from chunk_vectors where id > 0 and asset_id is not null")
def distinct_asset_ids(spark, d):
    return table(spark, d, "chunk_vectors").where("id > 0 and asset_id is not null").select("asset_id").distinct()


@query("""with ids as (select distinct unnest(asset_ids) as asset_id from search_results)
select i.asset_id, exists (select 1 from assets a where a.identifier = i.asset_id and a.name is not null) as found from ids i where i.asset_id is not null""")
def existence_probe(spark, d):
    ids = table(spark, d, "search_results").select(F.explode("asset_ids").alias("asset_id")).where("asset_id is not null").distinct()
    known = table(spark, d, "assets").where("name is not null").select(F.col("identifier").alias("asset_id"), F.lit(True).alias("_k")).distinct()
    return ids.join(known, "asset_id", "left").select("asset_id", F.coalesce("_k", F.lit(False)).alias("found"))


_LISTS = "select distinct query_id, asset_ids, distances, asset_types from search_results where asset_ids is not null"
_HITS = f"(select query_id, cast(pos - 1 as int) as pos, asset_ids[pos] as asset_id from (select *, unnest(range(1, len(asset_ids) + 1)) as pos from ({_LISTS})))"


def _lists(spark, d):
    return table(spark, d, "search_results").select("query_id", "asset_ids", "distances", "asset_types").where("asset_ids is not null").distinct()


@query(f"select h.query_id, h.pos, h.asset_id, a.name, a.platform from {_HITS} h left join (select distinct identifier, name, platform from assets) a on a.identifier = h.asset_id")
def translate_results(spark, d):
    documents = table(spark, d, "assets").select(F.col("identifier").alias("asset_id"), "name", "platform").distinct()
    return search.translate(_lists(spark, d), documents).select("query_id", "pos", "asset_id", "name", "platform")


@query(f"select query_id, pos + 1 as rank, asset_id from {_HITS} where pos + 1 between 2 and 5")
def result_slice(spark, d):
    hits = _lists(spark, d).select("query_id", F.posexplode("asset_ids").alias("pos", "asset_id")).withColumn("rank", F.col("pos") + 1)
    return search.slice_results(hits, 2, 5).select("query_id", "rank", "asset_id")


@query(f"""with own as (select distinct s.query_id, c.asset_id from search_results s join chunk_vectors c on c.id = s.vector_id)
select h.query_id, h.pos, h.asset_id from {_HITS} h where not exists (select 1 from own o where o.query_id = h.query_id and o.asset_id = h.asset_id)""")
def results_without_self(spark, d):
    hits = _lists(spark, d).select("query_id", F.posexplode("asset_ids").alias("pos", "asset_id"))
    chunks = table(spark, d, "chunk_vectors").select(F.col("id").alias("vector_id"), "asset_id").distinct()
    own = table(spark, d, "search_results").select("query_id", "vector_id").distinct().join(chunks, "vector_id").select("query_id", "asset_id").distinct()
    return hits.join(own, ["query_id", "asset_id"], "left_anti").select("query_id", "pos", "asset_id")


@query(f"""with {_CHUNKS}, best as (select q.id as query_id, c.asset_id, max({_SIM}) as sim from chunks q, chunks c where q.id % {EVERY} = 0 and c.asset_id in {_KNOWN} group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by sim desc, asset_id) as rank from best),
named as (select distinct identifier, name from assets),
blocks as (select r.query_id, r.rank, 'Result ' || cast(rank - 1 as varchar) || ':' || chr(10) || n.name || chr(10) || 'link:' || r.asset_id || chr(10) as b from ranked r join named n on n.identifier = r.asset_id where rank <= {K})
select query_id, string_agg(b, '' order by rank) as context from blocks group by query_id""")
def rag_context(spark, d):
    chunks = _chunks(spark, d)
    hits = search.validated(_asked(chunks), chunks, _described(spark, d), K)
    named = table(spark, d, "assets").select(F.col("identifier").alias("asset_id"), "name").distinct()
    return search.context_text(hits.join(named, "asset_id"), F.col("name"), F.col("asset_id"))


# Evaluation: an embedding is relevant to a query of the same label, grade 5 against 1.
_JUDGED = f"with {_EMBEDDED}, judged as (select query_id, rank, id, case when label = own then 5.0::double else 1.0::double end as score, label = own as rel, own from ranked where rank <= 20), totals as (select query_id, sum(case when label = own then 1 else 0 end) as n from scored group by 1)"


def _judged(spark, d):
    corpus, asked = _embeddings(spark, d)
    ranked = search.top_k(asked, corpus, 20).withColumnRenamed("asset_id", "label")
    own = asked.select("query_id", F.col("label").alias("own"))
    judged = ranked.join(own, "query_id").select("query_id", "rank", "id", "own", F.when(F.col("label") == F.col("own"), 5.0).otherwise(1.0).alias("score"))
    sizes = corpus.groupBy(F.col("asset_id").alias("own")).agg(F.count("*").alias("relevant_total"))
    return judged, own.join(sizes, "own").select("query_id", "relevant_total")


def _relevant():
    return F.col("score") >= 3


@query(f"{_JUDGED} select query_id, cast(k as int) as k, round(sum(case when rel and rank <= k then 1 else 0 end) / k, 6) as precision, round(sum(case when rel and rank <= k then 1 else 0 end) / max(n), 6) as recall from judged join totals using (query_id), (select unnest([3, 5, 10, 20]) as k) group by query_id, k")
def precision_recall_at_k(spark, d):
    ranked, totals = _judged(spark, d)
    out = evaluate.precision_recall(ranked, totals, _relevant(), (3, 5, 10, 20))
    return out.select("query_id", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_JUDGED}, cum as (select *, sum(case when rel then 1 else 0 end) over (partition by query_id order by rank) / rank as p from judged where rank <= 10) select query_id, round(sum(case when rel then p else 0 end) / max(n), 6) as ap from cum join totals using (query_id) group by query_id")
def average_precision_at_k(spark, d):
    ranked, totals = _judged(spark, d)
    return evaluate.average_precision(ranked, totals, _relevant(), 10).select("query_id", F.round("ap", 6).alias("ap"))


@query(f"{_JUDGED}, i as (select *, row_number() over (partition by query_id order by score desc, rank) as ir from judged) select query_id, round(sum(case when rank <= 10 then score / log2(rank + 1) else 0 end) / sum(case when ir <= 10 then score / log2(ir + 1) else 0 end), 6) as ndcg from i group by query_id")
def ndcg_at_k(spark, d):
    return evaluate.ndcg(_judged(spark, d)[0], 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


# The hit to find is the next vector of the same label that is not the query itself.
_FIRST = f"{_JUDGED}, f as (select query_id, own, min(case when rel and id <> query_id then rank end) as first from judged group by 1, 2)"


@query(f"{_FIRST} select cast(k as int) as k, round(avg(case when first <= k then 1.0::double else 0.0::double end), 6) as hit_rate, round(avg(case when first <= k then first - 1 end), 6) as position, count(*) as queries from f, (select unnest([1, 2, 5, 10, 20]) as k) group by k")
def hit_rate_at_k(spark, d):
    ranked, _ = _judged(spark, d)
    out = evaluate.hit_rate(ranked, ranked.select("query_id"), _relevant() & (F.col("id") != F.col("query_id")), (1, 2, 5, 10, 20))
    return out.select("k", F.round("hit_rate", 6).alias("hit_rate"), F.round("position", 6).alias("position"), "queries")


@query(f"{_JUDGED}, per as (select query_id, own, query_id % 3 as level, sum(case when rel and rank <= 10 then 1 else 0 end) / 10 as p from judged group by 1, 2, 3) select level, own::varchar as stratum, round(avg(p), 6) as precision, count(*) as queries from per group by grouping sets ((level, own), (level), (own), ())")
def metrics_grouping_sets(spark, d):
    ranked, totals = _judged(spark, d)
    per = evaluate.precision_recall(ranked, totals, _relevant(), (10,)).join(ranked.select("query_id", "own").distinct(), "query_id").withColumn("level", F.col("query_id") % 3)
    out = per.groupingSets([[F.col("level"), F.col("own")], [F.col("level")], [F.col("own")], []], F.col("level"), F.col("own")).agg(F.round(F.avg("precision"), 6).alias("precision"), F.count("*").alias("queries"))
    return out.withColumnRenamed("own", "stratum").select("level", "stratum", "precision", "queries")


@query(f"{_JUDGED}, per as (select own, k, avg(h) as p from (select query_id, own, k, sum(case when rel and rank <= k then 1 else 0 end) / k as h from judged, (select unnest([3, 5, 10]) as k) group by 1, 2, 3) group by 1, 2), r as (select *, dense_rank() over (partition by k order by round(p, 6) desc) as place from per) select own::varchar as variant, round(max(case when k = 3 then p end), 6) as p_3, round(max(case when k = 5 then p end), 6) as p_5, round(max(case when k = 10 then p end), 6) as p_10 from per group by own")
def result_pivot(spark, d):
    ranked, totals = _judged(spark, d)
    per = evaluate.precision_recall(ranked, totals, _relevant(), (3, 5, 10)).join(ranked.select("query_id", F.col("own").alias("variant")).distinct(), "query_id")
    wide = per.groupBy("variant").pivot("k", [3, 5, 10]).agg(F.round(F.avg("precision"), 6))
    return wide.select("variant", *[F.col(str(k)).alias(f"p_{k}") for k in (3, 5, 10)])


@query(f"{_JUDGED}, per as (select own::varchar as variant, round(avg(h), 6) as metric from (select query_id, own, sum(case when rel and rank <= 10 then 1 else 0 end) / 10 as h from judged group by 1, 2) group by 1), r as (select *, dense_rank() over (order by metric desc) as place from per) select variant, metric, cast(place as int) as place from r where place <= 2")
def ranking_highlight(spark, d):
    ranked, totals = _judged(spark, d)
    per = evaluate.precision_recall(ranked, totals, _relevant(), (10,)).join(ranked.select("query_id", F.col("own").alias("variant")).distinct(), "query_id")
    report = per.groupBy("variant").agg(F.round(F.avg("precision"), 6).alias("metric"))
    return evaluate.best_two(report, "metric")


def _pool_sql(expr: str) -> str:
    return f"with {_CHUNKS}, e as (select asset_id, id, unnest(range(0, 64)) as pos, unnest(vector) as x from chunks where asset_id is not null) select asset_id, cast(pos as int) as pos, round({expr}, 6) as value from e group by asset_id, pos"


def _pool(spark, d, how):
    out = evaluate.pooled(_once(spark, d).where("asset_id is not null"), how)
    return out.select("asset_id", "pos", F.round("value", 6).alias("value"))


@query(_pool_sql("avg(x)"))
def pool_mean(spark, d):
    return _pool(spark, d, "mean")


@query(_pool_sql("max(x)"))
def pool_max(spark, d):
    return _pool(spark, d, "max")


@query(_pool_sql("arg_min(x, id)"))
def pool_cls(spark, d):
    return _pool(spark, d, "cls")
