"""Queries of filters, joins, change data, storage and the query log."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from lodeweave import runtime
from lodeweave.operators import ingest, lifecycle, store, vector_store
from lodeweave.plans.filter_dsl import Expression, Filter, compile_filters
from lodeweave.plans.registry import query
from lodeweave.runtime import table
from lodeweave.schema import FieldSpec, Registry

#: The filterable columns of the metadata table and of the catalogue.
METADATA = Registry([
    FieldSpec("license"), FieldSpec("task_types", is_list=True), FieldSpec("languages", is_list=True),
    FieldSpec("datapoints_lower_bound", "long", "numerical"), FieldSpec("datapoints_upper_bound", "long", "numerical"),
    FieldSpec("date_published", kind="date"),
])
CATALOGUE = Registry([FieldSpec("name", text_match=True), FieldSpec("platform"), FieldSpec("type"), FieldSpec("keyword", is_list=True)])


def _filter(field, *comparisons, join="AND"):
    return Filter(field, join, tuple(Expression(v, op) for op, v in comparisons))


def _metadata(spark, d, *filters, exclude=()):
    return table(spark, d, "dataset_metadata").where(compile_filters(filters, METADATA, exclude)).select("meta_id").distinct()


def _meta_sql(where: str) -> str:
    return f"select distinct meta_id from dataset_metadata where {where}"


@query(_meta_sql("datapoints_lower_bound >= 1000 and datapoints_lower_bound < 100000"))
def filter_range(spark, d):
    return _metadata(spark, d, _filter("datapoints_lower_bound", (">=", 1000), ("<", 100000)))


@query(_meta_sql("lower(license) = 'olc-by-4.0' or lower(license) = 'olc-by-3.0'"))
def filter_or(spark, d):
    return _metadata(spark, d, _filter("license", ("==", "OLC-BY-4.0"), ("==", "olc-by-3.0"), join="OR"))


@query(_meta_sql("lower(license) <> 'olc-by-2.0'"))
def filter_not_equal(spark, d):
    return _metadata(spark, d, _filter("license", ("!=", "olc-by-2.0")))


@query(_meta_sql("datapoints_lower_bound > 500 and datapoints_upper_bound <= 1000000 and list_contains(list_transform(languages, lambda x: lower(x)), 'en') and asset_id not in ('data_Qm4tZ81xWc0LrVb6NeYp7KdA')"))
def filter_multi(spark, d):
    return _metadata(spark, d, _filter("datapoints_lower_bound", (">", 500)), _filter("datapoints_upper_bound", ("<=", 1000000)), _filter("languages", ("==", "EN")), exclude=["data_Qm4tZ81xWc0LrVb6NeYp7KdA"])


@query(_meta_sql("list_contains(list_transform(task_types, lambda x: lower(x)), 'gait-recognition') or list_contains(list_transform(task_types, lambda x: lower(x)), 'crop-row-detection')"))
def filter_array_contains(spark, d):
    return _metadata(spark, d, _filter("task_types", ("==", "gait-recognition"), ("==", "crop-row-detection"), join="OR"))


@query(_meta_sql("not list_contains(list_transform(languages, lambda x: lower(x)), 'en')"))
def filter_not_array_contains(spark, d):
    return _metadata(spark, d, _filter("languages", ("!=", "en")))


_MATCH = "len(list_intersect(list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ['archive', 'search'])) > 0"


@query(f"select distinct identifier from assets where {_MATCH}")
def filter_text_match(spark, d):
    return table(spark, d, "assets").where(compile_filters([_filter("name", ("==", "Archive search"))], CATALOGUE)).select("identifier").distinct()


@query(f"select distinct identifier from assets where not ({_MATCH}) and lower(platform) = 'robohub'")
def filter_not_text_match(spark, d):
    return table(spark, d, "assets").where(compile_filters([_filter("name", ("!=", "archive search")), _filter("platform", ("==", "RoboHub"))], CATALOGUE)).select("identifier").distinct()


@query(_meta_sql("try_cast(regexp_replace(date_published, 'Z$', '') as timestamp) > timestamp '2018-01-01 00:00:00' and try_cast(regexp_replace(date_published, 'Z$', '') as timestamp) <= timestamp '2021-06-30 12:00:00'"))
def filter_date(spark, d):
    return _metadata(spark, d, _filter("date_published", (">", "2018-01-01T00:00:00"), ("<=", "2021-06-30T12:00:00")))


@query("select m.license, m.ok, count(*) as rows from (select distinct meta_id, license, lower(license) in (select lower(value) from field_valid_values where field = 'license' and asset_type = 'base') as ok from dataset_metadata where license is not null) m group by 1, 2")
def filter_value_legality(spark, d):
    """Which entered licences would be accepted as the value of a filter."""
    spec = METADATA.with_values(table(spark, d, "field_valid_values"))["license"]
    entered = table(spark, d, "dataset_metadata").where("license is not null").select("meta_id", "license").distinct()
    return entered.groupBy("license", spec.valid(F.col("license")).alias("ok")).agg(F.count("*").alias("rows"))


@query(_meta_sql("lower(license) in (select lower(value) from field_valid_values where field = 'license' and asset_type = 'base' and value like '%-4.0') and license is not null"))
def filter_enum_values(spark, d):
    """Filters on each allowed value that ends in an edition, five to a filter, checked against the list."""
    fields = METADATA.with_values(table(spark, d, "field_valid_values"))
    wanted = [v for v in fields["license"].values if v.endswith("-4.0")]
    parts = [compile_filters([_filter("license", *[("==", v.upper()) for v in wanted[i : i + 5]], join="OR")], fields) for i in range(0, len(wanted), 5)]
    rows = table(spark, d, "dataset_metadata")
    return rows.where(reduce(lambda a, b: a | b, parts, F.lit(False))).select("meta_id").distinct()


# Change data: the catalogue is the asset table, the store is the chunk table.
def _catalogue(spark, d):
    a = table(spark, d, "assets")
    return a.select(F.col("identifier").alias("asset_id"), F.col("type").alias("asset_type"), "harvested_at", F.try_to_timestamp("aiod_entry.date_modified").cast("timestamp_ntz").alias("modified"))


_CUT = "timestamp '2021-01-01'"


def _cut():
    return F.lit("2021-01-01").cast("timestamp_ntz")


@query(f"select distinct identifier as asset_id from assets where identifier not in (select asset_id from chunk_vectors where asset_id is not null) and identifier not in (select identifier from assets where harvested_at < {_CUT} and identifier is not null)")
def ingest_new(spark, d):
    c = _catalogue(spark, d)
    return ingest.new_assets(c, table(spark, d, "chunk_vectors"), c.where(F.col("harvested_at") < _cut())).select("asset_id")


@query(f"select distinct identifier as asset_id from assets where try_cast(aiod_entry.date_modified as timestamp) >= {_CUT} and identifier in (select asset_id from chunk_vectors)")
def ingest_changed(spark, d):
    return ingest.changed_assets(_catalogue(spark, d), table(spark, d, "chunk_vectors"), F.col("modified"), _cut()).select("asset_id").distinct()


@query(f"select distinct asset_id from chunk_vectors where asset_id is not null and asset_id not in (select identifier from assets where harvested_at < {_CUT} and identifier is not null)")
def stale_assets(spark, d):
    return ingest.stale_assets(table(spark, d, "chunk_vectors"), _catalogue(spark, d).where(F.col("harvested_at") < _cut()))


@query(f"select distinct asset_id from chunk_vectors where asset_id is not null except select identifier from assets where harvested_at < {_CUT}")
def set_difference(spark, d):
    stored = table(spark, d, "chunk_vectors").where("asset_id is not null").select("asset_id")
    return stored.subtract(_catalogue(spark, d).where(F.col("harvested_at") < _cut()).select("asset_id"))


@query("select asset_id from chunk_vectors where asset_id is not null intersect select asset_id from documents where asset_id is not null")
def set_intersection(spark, d):
    return table(spark, d, "chunk_vectors").where("asset_id is not null").select("asset_id").intersect(table(spark, d, "documents").where("asset_id is not null").select("asset_id"))


@query("select 'documents' as origin, asset_id, count(*) as n from documents group by 2 union all select 'chunks', asset_id, count(*) from chunk_vectors group by 2 union all select 'metadata', asset_id, count(*) from dataset_metadata group by 2")
def union_of_origins(spark, d):
    part = lambda name, origin: table(spark, d, name).groupBy("asset_id").agg(F.count("*").alias("n")).select(F.lit(origin).alias("origin"), "asset_id", "n")
    return part("documents", "documents").unionByName(part("chunk_vectors", "chunks")).unionByName(part("dataset_metadata", "metadata"))


_STORED = "(select distinct id, asset_id, asset_version, asset_type from chunk_vectors)"


@query(f"""with q as (select asset_id, max(asset_version) as asset_version, 'refreshed' as note from {_STORED} where asset_id is not null and asset_version is not null group by 1)
select s.id, s.asset_id, s.asset_version, q.note from {_STORED} s join q using (asset_id, asset_version)""")
def queue_join_versions(spark, d):
    s = _stored(spark, d)
    q = s.where("asset_id is not null and asset_version is not null").groupBy("asset_id").agg(F.max("asset_version").alias("asset_version")).withColumn("note", F.lit("refreshed"))
    return s.join(q, ["asset_id", "asset_version"]).select("id", "asset_id", "asset_version", "note")


def _stored(spark, d):
    return table(spark, d, "chunk_vectors").select("id", "asset_id", "asset_version", "asset_type").distinct()


@query(f"""with u as (select asset_id, max(asset_version) as asset_version, 'updated' as t from {_STORED} where asset_type = 'datasets' and asset_id is not null group by 1)
select s.id, s.asset_id, s.asset_version, coalesce(u.t, s.asset_type) as asset_type from {_STORED} s left join u on u.asset_id = s.asset_id and u.asset_version = s.asset_version""")
def override_columns(spark, d):
    s = _stored(spark, d)
    u = s.where("asset_type = 'datasets' and asset_id is not null").groupBy("asset_id").agg(F.max("asset_version").alias("asset_version")).withColumn("asset_type", F.lit("updated"))
    return store.override_columns(s, u, ["asset_id", "asset_version"], ["asset_type"]).select("id", "asset_id", "asset_version", "asset_type")


_NEW = f"(select id, asset_id, coalesce(asset_version, 0) + 1 as asset_version, asset_type from {_STORED} where asset_type = 'ml_models')"


@query(f"select * from {_STORED} where id not in (select id from {_NEW}) union all select * from {_NEW}")
def upsert_rows(spark, d):
    s = _stored(spark, d)
    new = s.where("asset_type = 'ml_models'").withColumn("asset_version", F.coalesce("asset_version", F.lit(0)) + 1)
    return store.upsert(s, new)


@query(f"select asset_id, max(asset_version) as last_version, count(*) as chunks from {_STORED} where asset_id in (select identifier from assets where platform = 'robohub') group by asset_id")
def delete_returning(spark, d):
    gone = table(spark, d, "assets").where("platform = 'robohub'").select(F.col("identifier").alias("asset_id"))
    return store.delete(_stored(spark, d), gone)[1]


@query(f"select * from {_STORED} s where not exists (select 1 from assets a where a.platform = 'robohub' and a.identifier = s.asset_id)")
def delete_kept(spark, d):
    gone = table(spark, d, "assets").where("platform = 'robohub'").select(F.col("identifier").alias("asset_id"))
    return store.delete(_stored(spark, d), gone)[0].select("id", "asset_id", "asset_version", "asset_type")


@query(f"select a.identifier as asset_id, coalesce(v, -1) + 1 as version from (select distinct identifier from assets) a left join (select asset_id, max(asset_version) as v from {_STORED} group by 1) s on s.asset_id = a.identifier")
def next_versions(spark, d):
    return store.next_versions(_stored(spark, d), _catalogue(spark, d))


@query("select meta_id, case when ok then license end as license, ok as metadata_kept from (select distinct meta_id, license, coalesce(length(license) <= 24, true) and coalesce(len(task_types) <= 2, true) as ok from dataset_metadata where asset_id is not null)")
def insert_fallback(spark, d):
    registry = Registry([FieldSpec("license", max_length=24), FieldSpec("task_types", is_list=True, max_items=2)])
    rows = table(spark, d, "dataset_metadata").select("meta_id", "asset_id", "license", "task_types").distinct()
    good, _ = store.with_fallback(rows, registry, F.col("asset_id").isNotNull())
    return good.select("meta_id", "license", "metadata_kept").distinct()


@query(f"""with kept as (select * from {_STORED} where asset_type = 'datasets' and asset_id not in (select identifier from assets where platform = 'robohub' and identifier is not null))
select asset_id, count(distinct id) as chunks, max(asset_version) as last_version from kept where asset_id is not null group by 1""")
def vector_store_cycle(spark, d):
    """A collection is filled, filled again with half of its rows, and loses the assets of one platform."""
    chunks = table(spark, d, "chunk_vectors").where("asset_type = 'datasets'")
    held = vector_store.ParquetStore(spark, f"{runtime.shared_folder(spark)}/stores/{uuid.uuid4().hex}")
    held.upsert("datasets", chunks)
    held.upsert("datasets", chunks.where("id % 2 = 0"))
    held.remove("datasets", table(spark, d, "assets").where("platform = 'robohub'").select(F.col("identifier").alias("asset_id")))
    return held.read("datasets").where("asset_id is not null").groupBy("asset_id").agg(F.countDistinct("id").alias("chunks"), F.max("asset_version").alias("last_version"))


_PAGES = "(select distinct query_id, asset_ids, distances from search_results where asset_ids is not null and distances is not null and len(asset_ids) = len(distances))"


@query(f"select query_id as page, cast(pos as int) as pos, a as asset_id, v as distance from (select query_id, unnest(range(0, len(asset_ids))) as pos, unnest(asset_ids) as a, unnest(distances) as v from {_PAGES})")
def bulk_pairs(spark, d):
    pages = table(spark, d, "search_results").select(F.col("query_id").alias("page"), "asset_ids", F.col("distances").alias("vectors")).distinct()
    return store.bulk_pairs(pages).select("page", "pos", "asset_id", F.col("vector").alias("distance"))


_LOG = "(select distinct query_id, status, topk, created_at, updated_at, expires_at from search_results)"
_STATUS = "case replace(lower(trim(status)), ' ', '_') when 'queued' then 'Queued' when 'in_progress' then 'In_progress' when 'completed' then 'Completed' when 'failed' then 'Failed' end"
_SEEN = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _log(spark, d):
    return table(spark, d, "search_results").select("query_id", "status", "topk", "created_at", "updated_at", "expires_at").distinct()


def _seen(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"select query_id, {_SEEN('created_at')} as created from {_LOG} order by created_at, query_id limit 100")
def fifo_batch(spark, d):
    return store.fifo(_log(spark, d), 100, "created_at", "query_id").select("query_id", _seen(F.col("created_at")).alias("created"))


@query(f"select query_id, {_STATUS} as status, row_number() over (order by {_STATUS} <> 'In_progress', updated_at, query_id) - 1 as row_no from {_LOG} where {_STATUS} in ('Queued', 'In_progress')")
def query_queue_order(spark, d):
    work = _log(spark, d).withColumn("status", lifecycle.status_of(F.col("status"))).where(F.col("status").isin(lifecycle.QUEUED, lifecycle.IN_PROGRESS))
    ranked = work.withColumn("_s", (F.col("status") != lifecycle.IN_PROGRESS).cast("int"))
    return store.number_rows(ranked, ["_s", "updated_at", "query_id"]).select("query_id", "status", "row_no")


@query(f"select {_STATUS} as status, count(*) as n, count(distinct query_id) as queries from {_LOG} group by 1")
def status_counts(spark, d):
    return _log(spark, d).groupBy(lifecycle.status_of(F.col("status")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


@query(f"select query_id, case when {_STATUS} in ('Completed', 'Failed') then {_SEEN('updated_at + interval 10 minutes')} end as expires, coalesce(expires_at < timestamp '2025-01-03', false) as expired from {_LOG}")
def query_expiry(spark, d):
    log = _log(spark, d)
    expires = lifecycle.expires_at(F.col("status"), F.col("updated_at"), 10)
    return log.select("query_id", _seen(expires).alias("expires"), lifecycle.is_expired(F.col("expires_at"), F.lit("2025-01-03").cast("timestamp_ntz")).alias("expired"))


# A collection log per asset type, its updates being the months of the stored chunks' catalogue entries.
_MONTHS = "(select type as asset_type, strftime(date_trunc('month', harvested_at), '%Y-%m') as m, count(*) as added, sum(case when date_published is null then 1 else 0 end)::bigint as removed from (select distinct * from assets) where type is not null group by 1, 2)"


def _collection_log(spark, d):
    a = table(spark, d, "assets").where("type is not null").select("identifier", "type", "harvested_at", "date_published").distinct()
    m = a.groupBy(F.col("type").alias("asset_type"), F.date_format("harvested_at", "yyyy-MM").alias("m")).agg(F.count("*").alias("embeddings_added"), F.sum(F.col("date_published").isNull().cast("long")).alias("embeddings_removed"))
    # Every other month counts as one in which nothing happened.
    quiet = (F.substring("m", 6, 2).cast("int") % 2) == 0
    m = m.withColumns({c: F.when(quiet, F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("embeddings_added", "embeddings_removed")})
    updates = m.groupBy("asset_type").agg(F.sort_array(F.collect_list(F.struct("m", "embeddings_added", "embeddings_removed"))).alias("recurring"))
    return updates.withColumn("setup", F.struct(F.lit(5).cast("long").alias("embeddings_added")))


_QUIET = f"(select asset_type, m, case when cast(m[6:7] as int) % 2 = 0 then 0 else added end as a, case when cast(m[6:7] as int) % 2 = 0 then 0 else removed end as r from {_MONTHS})"


@query(f"select asset_type, cast(5 + sum(a) - sum(r) as bigint) as num_embeddings from {_QUIET} group by 1")
def update_log_counts(spark, d):
    return ingest.embedding_count(_collection_log(spark, d))


@query(f"select asset_type, string_agg(m, ',' order by m) as kept, max(m) as last from {_QUIET} q where a + r > 0 or m = (select max(m) from {_QUIET} z where z.asset_type = q.asset_type) group by 1")
def prune_empty_updates(spark, d):
    log = _collection_log(spark, d)
    return log.select("asset_type", F.array_join(F.transform(ingest.prune_updates(F.col("recurring")), lambda u: u["m"]), ",").alias("kept"), ingest.last_update(F.col("recurring"))["m"].alias("last"))


@query("""with o as (select source || '/' || coalesce(asset_id, '') as url, max(strftime(created_at, '%Y-%m-%d')) as v from documents where source is not null and created_at < timestamp '2024-06-01' group by 1),
n as (select source || '/' || coalesce(asset_id, '') as url, max(strftime(created_at, '%Y-%m-%d')) as v from documents where source is not null and created_at >= timestamp '2024-03-01' group by 1)
select coalesce(o.url, n.url) as url, case when o.url is null then 'insert' when n.url is null then 'delete' when o.v <> n.v then 'update' else 'keep' end as change from o full join n on o.url = n.url""")
def crawl_delta(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select(F.concat("source", F.lit("/"), F.coalesce("asset_id", F.lit(""))).alias("url"), F.date_format("created_at", "yyyy-MM-dd").alias("last_modified"), "created_at")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return ingest.crawl_delta(docs.where(F.col("created_at") < at("2024-06-01")), docs.where(F.col("created_at") >= at("2024-03-01")))


_LINKS = "(select distinct c.asset_id as src, a as dst from (select vector_id, unnest(asset_ids) as a from search_results) s join chunk_vectors c on c.id = s.vector_id where a is not null and c.asset_id is not null)"


@query(f"""with recursive walk(node, depth) as (select 'data_Qm4tZ81xWc0LrVb6NeYp7KdA', 0 union select l.dst, w.depth + 1 from walk w join {_LINKS} l on l.src = w.node where w.depth < 3)
select node, cast(min(depth) as int) as depth from walk group by node""")
def crawl_bfs(spark, d):
    chunks = table(spark, d, "chunk_vectors").where("asset_id is not null").select(F.col("id").alias("vector_id"), F.col("asset_id").alias("src")).distinct()
    hits = table(spark, d, "search_results").where("vector_id is not null").select("vector_id", F.explode("asset_ids").alias("dst")).where("dst is not null")
    links = hits.join(chunks, "vector_id").select("src", "dst").distinct()
    starts = spark.createDataFrame([("data_Qm4tZ81xWc0LrVb6NeYp7KdA",)], "node string")
    return ingest.reach(links, starts, 3)


@query(f"""with recursive pages(src, dst) as (select distinct 'https://' || split_part(src, '_', 1) || '.example.org/' || src || '.html', 'https://' || split_part(dst, '_', 1) || '.example.org/' || dst || '.html' from {_LINKS}),
walk(node, depth) as (select 'https://data.example.org/data_Qm4tZ81xWc0LrVb6NeYp7KdA.html', 0 union select p.dst, w.depth + 1 from walk w join pages p on p.src = w.node where w.depth < 2 and p.dst not like 'https://publ.example.org/%')
select node, cast(min(depth) as int) as depth from walk group by node""")
def crawl_rules(spark, d):
    """The links as pages of a site, crawled without one of its blocked parts."""
    chunks = table(spark, d, "chunk_vectors").where("asset_id is not null").select(F.col("id").alias("vector_id"), F.col("asset_id").alias("src")).distinct()
    hits = table(spark, d, "search_results").where("vector_id is not null").select("vector_id", F.explode("asset_ids").alias("dst")).where("dst is not null")
    page = lambda c: F.concat(F.lit("https://"), F.split(c, "_")[0], F.lit(".example.org/"), F.col(c), F.lit(".html")).alias(c)
    links = hits.join(chunks, "vector_id").select(page("src"), page("dst")).distinct()
    starts = spark.createDataFrame([("https://data.example.org/data_Qm4tZ81xWc0LrVb6NeYp7KdA.html",)], "node string")
    return ingest.reach(links, starts, 2, ingest.crawl_rule("example.org", ("https://publ.example.org/",)))


@query("""with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as n from orders),
p as (select o_orderkey, unnest(range(cast(greatest(ceil((n - 999) / 900.0), 0) as bigint), n // 900 + 1)) as page from r)
select page, count(*) as rows, min(o_orderkey) as low, max(o_orderkey) as high from p group by page""")
def page_overlap(spark, d):
    on = store.pages(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000, 0.1)
    return on.groupBy("page").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("select o_orderkey from orders")
def page_overlap_dedup(spark, d):
    on = store.pages(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000, 0.1)
    return on.select("o_orderkey").distinct()


@query("with r as (select (row_number() over (order by o_orderdate, o_orderkey) - 1) // 1000 as page from orders) select page, count(*) as rows, count(*) = 1000 as complete from r group by page")
def page_completeness(spark, d):
    return store.page_completeness(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000)


@query("select asset_id, row_number() over (partition by asset_id order by created_at, doc_id) - 1 as place, source as role, doc_id from documents where asset_id is not null")
def conversation_history(spark, d):
    docs = table(spark, d, "documents").where("asset_id is not null").select(F.col("asset_id").alias("conv_id"), F.struct("created_at", "doc_id").alias("turn"), F.col("source").alias("role"), F.col("doc_id").cast("string").alias("text"))
    return lifecycle.conversation(docs).select(F.col("conv_id").alias("asset_id"), "place", "role", F.col("text").cast("long").alias("doc_id"))


@query("select source, g, string_agg(cast(doc_id as varchar), ' ' order by doc_id) as docs from (select coalesce(source, '') as source, doc_id, (row_number() over (partition by coalesce(source, '') order by doc_id) - 1) // 5 as g from documents) group by 1, 2")
def prompt_groups(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id")
    numbered = store.number_within(docs, "source", ["doc_id"]).withColumn("g", F.floor(F.col("place") / 5))
    return numbered.groupBy("source", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("docs"))


@query("select meta_id, coalesce(t.title, m.license) as license from (select distinct meta_id, license from dataset_metadata) m left join (select value, title from field_valid_values where field = 'license' and asset_type = 'base') t on t.value = m.license")
def merge_with_precedence(spark, d):
    m = table(spark, d, "dataset_metadata").select("meta_id", "license").distinct()
    t = table(spark, d, "field_valid_values").where("field = 'license' and asset_type = 'base'").select(F.col("value").alias("license"), "title")
    return m.join(t, "license", "left").select("meta_id", F.coalesce("title", "license").alias("license"))


@query("select distinct identifier, cast(len(list_filter(keyword, lambda k: not list_contains(['crop rows', 'tram delays', 'weld seams'], k))) as int) as others from assets where keyword is not null")
def subset_check(spark, d):
    known = F.array(*map(F.lit, ("crop rows", "tram delays", "weld seams")))
    return table(spark, d, "assets").where("keyword is not null").select("identifier", F.size(F.filter("keyword", lambda k: ~F.array_contains(known, k))).alias("others")).distinct()


@query("""with q as (select distinct query_id, vector_id, asset_ids from search_results where asset_ids is not null),
r as (select query_id, vector_id, unnest(range(0, len(asset_ids))) as pos, unnest(asset_ids) as asset_id from q),
j as (select r.*, c.asset_type as own from r join (select distinct id, asset_type from chunk_vectors) c on c.id = r.vector_id)
select query_id, own, string_agg(a.type, ',' order by pos, a.type) as types from j join (select distinct identifier, type from assets) a on a.identifier = j.asset_id group by 1, 2""")
def judged_results(spark, d):
    q = table(spark, d, "search_results").select("query_id", "vector_id", "asset_ids").distinct().select("query_id", "vector_id", F.posexplode("asset_ids").alias("pos", "asset_id"))
    own = table(spark, d, "chunk_vectors").select(F.col("id").alias("vector_id"), F.col("asset_type").alias("own")).distinct()
    kinds = table(spark, d, "assets").select(F.col("identifier").alias("asset_id"), "type").distinct()
    j = q.join(own, "vector_id").join(kinds, "asset_id")
    return j.groupBy("query_id", "own").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]), ",").alias("types"))


@query("select distinct asset_id from documents where asset_id is not null and not exists (select 1 from dataset_metadata m where m.asset_id = documents.asset_id)")
def skip_computed(spark, d):
    docs = table(spark, d, "documents").select("asset_id").where("asset_id is not null").distinct()
    return docs.join(table(spark, d, "dataset_metadata").select("asset_id"), "asset_id", "left_anti")


@query("select query_id, cast(len(asset_ids) as int) as listed, asset_ids is not null and distances is not null and len(asset_ids) = len(distances) as whole from (select distinct query_id, asset_ids, distances from search_results)")
def topk_cache_coverage(spark, d):
    s = table(spark, d, "search_results").select("query_id", "asset_ids", "distances").distinct()
    whole = F.coalesce(F.size("asset_ids") == F.size("distances"), F.lit(False)) & F.col("asset_ids").isNotNull() & F.col("distances").isNotNull()
    return s.select("query_id", F.when(F.col("asset_ids").isNotNull(), F.size("asset_ids")).alias("listed"), whole.alias("whole"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def relational_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select n_name, round(sum(o_totalprice), 2) as total, count(*) as orders from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by n_name")
def relational_join(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("orders"))


@query("select distinct lower(trim(value)) as value, tx from (select unnest(keyword) as value, 'keyword' as tx from assets union all select unnest(task_types), 'task' from dataset_metadata) where value is not null")
def distinct_values(spark, d):
    k = table(spark, d, "assets").select(F.explode("keyword").alias("value"), F.lit("keyword").alias("tx"))
    t = table(spark, d, "dataset_metadata").select(F.explode("task_types").alias("value"), F.lit("task").alias("tx"))
    return k.unionByName(t).where("value is not null").select(F.lower(F.trim("value")).alias("value"), "tx").distinct()


