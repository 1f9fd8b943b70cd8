"""Queries of text, metadata extraction and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as tx
from lodeweave.functions.vector import hash_embedding
from lodeweave.operators import embedding, evaluate, normalise
from lodeweave.plans.registry import query
from lodeweave.runtime import table

SIZE, OVERLAP, CAP = 100, 0.25, 11
_STEP = SIZE - int(SIZE * OVERLAP)
_TOKENS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda t: t <> '')"
_TEXT = lambda c: f"case when {c}.plain is not null and {c}.html is not null then {c}.plain || ' ' || regexp_replace({c}.html, '<[^>]*>', ' ', 'g') else coalesce({c}.plain, regexp_replace({c}.html, '<[^>]*>', ' ', 'g')) end"
_WINDOWS = f"toks as (select doc_id, {_TOKENS} as t from documents), w as (select doc_id, t, unnest(range(0, cast(greatest(ceil((len(t) - {SIZE}) / {_STEP}.0), 0) as bigint) + 1)) as i from toks)"


def _docs(spark, d):
    return table(spark, d, "documents")


@query(f"with {_WINDOWS} select doc_id, cast(i as int) as chunk_no, array_to_string(t[i * {_STEP} + 1 : i * {_STEP} + {SIZE}], ' ') as chunk from w where len(t) > 0")
def chunk_documents(spark, d):
    docs = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return docs.select("doc_id", F.posexplode(tx.windows(F.col("t"), SIZE, OVERLAP)).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.array_join("c", " ").alias("chunk"))


@query(f"with {_WINDOWS} select doc_id, count(*) as chunks, max(len(t)) as tokens from w group by doc_id")
def chunk_count(spark, d):
    docs = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size(tx.windows(F.col("t"), SIZE, OVERLAP)).cast("long").alias("chunks"), F.size("t").cast("long").alias("tokens"))


@query(f"with {_WINDOWS} select doc_id, least(count(*), {CAP}) as kept from w where len(t) > 0 group by doc_id")
def chunk_cap(spark, d):
    docs = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return docs.select("doc_id", F.size(tx.windows(F.col("t"), SIZE, OVERLAP, CAP)).cast("long").alias("kept"))


@query(f"with {_WINDOWS}, c as (select doc_id, i, t[i * {_STEP} + 1 : i * {_STEP} + {SIZE}] as k from w where len(t) > 0) select doc_id, cast(i as int) as chunk_no, cast({SIZE} as int) as width, cast(len(k) as int) as real, k[len(k)] as last_real, case when len(k) < {SIZE} then '[PAD]' else k[{SIZE}] end as last from c")
def chunk_padding(spark, d):
    docs = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    cut = docs.select("doc_id", F.posexplode(tx.windows(F.col("t"), SIZE, OVERLAP)).alias("chunk_no", "c")).withColumn("p", tx.padded(F.col("c"), SIZE))
    real = F.aggregate("p.mask", F.lit(0), lambda a, x: a + x)
    return cut.select("doc_id", "chunk_no", F.size("p.tokens").alias("width"), real.alias("real"), F.element_at("p.tokens", real).alias("last_real"), F.element_at("p.tokens", F.lit(SIZE)).alias("last"))


def _assets(spark, d):
    """Catalogue records, each delivery of the same record once."""
    a = table(spark, d, "assets")
    return a.withColumn("_t", F.xxhash64(*a.columns)).dropDuplicates(["identifier", "_t"]).drop("_t")


_ASSETS = "(select distinct * from assets)"


@query(f"""select identifier, 'Platform: ' || coalesce(platform, 'None') || chr(10) || 'Asset name: ' || coalesce(name, 'None')
  || coalesce(chr(10) || 'Description: ' || ({_TEXT('description')}), '')
  || case when len(keyword) > 0 then chr(10) || 'Keywords: ' || array_to_string(keyword, ' | ') else '' end as text from {_ASSETS}""")
def stringify_basic(spark, d):
    a = _assets(spark, d)
    return a.select("identifier", tx.stringify_basic(F.col("platform"), F.col("name"), tx.text_of(F.col("description")), F.col("keyword")).alias("text"))


_LINE = lambda k, v: f"coalesce('{k}: ' || {v} || chr(10), '')"
_ENTRY = """list_filter(list_transform(distribution, lambda d: concat_ws(', ', 'name:' || d.name, 'description:' || d.description, 'content_size_kb:' || d.content_size_kb, 'encoding_format:' || d.encoding_format)), lambda x: x <> '')"""


@query(f"""select identifier, {_LINE('platform', 'platform')} || {_LINE('name', 'name')} || {_LINE('date_published', 'date_published')} || {_LINE('description', '(' + _TEXT('description') + ')')} || {_LINE('content', '(' + _TEXT('content') + ')')}
  || case when type = 'datasets' then coalesce('size: ' || size.value || ' ' || size.unit || chr(10), '') else '' end || chr(10)
  || coalesce(case when len(keyword) > 0 then 'keyword: ' || array_to_string(keyword, ', ') || chr(10) end, '')
  || coalesce(case when len(list_filter(list_transform(note, lambda n: n.value), lambda x: x is not null)) > 0 then 'note: ' || array_to_string(list_transform(note, lambda n: n.value), ', ') || chr(10) end, '') || chr(10)
  || coalesce(case when len({_ENTRY}) > 0 then 'DISTRIBUTION:' || chr(10) || array_to_string(list_transform({_ENTRY}, lambda x: chr(9) || x || chr(10)), '') end, '') as text from {_ASSETS}""")
def stringify_relevant(spark, d):
    a = _assets(spark, d)
    size = F.when(F.col("type") == "datasets", F.concat(F.col("size.value").cast("string"), F.lit(" "), F.col("size.unit")))
    flat = {"platform": F.col("platform"), "name": F.col("name"), "date_published": F.col("date_published"), "description": tx.text_of(F.col("description")), "content": tx.text_of(F.col("content")), "size": size}
    notes = F.array_compact(F.transform("note", lambda n: n["value"]))
    # Sizes in MB and GB are left to the query of their own, as engines print fractions differently.
    part = lambda k, v: F.concat(F.lit(f"{k}:"), v.cast("string"))
    entries = F.filter(F.transform("distribution", lambda e: F.concat_ws(", ", *[part(k, e[k]) for k in ("name", "description", "content_size_kb", "encoding_format")])), lambda x: x != "")
    return a.select("identifier", tx.stringify_relevant(flat, {"keyword": F.col("keyword"), "note": notes}, {"distribution": entries}).alias("text"))


@query(f"select identifier, md5({_TEXT('description')}) as description_md5, md5({_TEXT('content')}) as content_md5, md5(coalesce(description.plain, regexp_replace(description.html, '<[^>]*>', ' ', 'g'))) as plain_first_md5 from {_ASSETS}")
def html_strip(spark, d):
    h = lambda c: F.md5(c.cast("binary"))
    return _assets(spark, d).select("identifier", h(tx.text_of(F.col("description"))).alias("description_md5"), h(tx.text_of(F.col("content"))).alias("content_md5"), h(tx.text_of(F.col("description"), True)).alias("plain_first_md5"))


@query(f"select identifier, cast(pos as int) as item_no, round(kb / 1024.0::double, 2) as mb, round(kb / 1048576.0::double, 2) as gb from (select identifier, unnest(range(0, len(distribution))) as pos, unnest(distribution).content_size_kb as kb from {_ASSETS}) where kb is not null")
def size_conversion(spark, d):
    a = _assets(spark, d).select("identifier", F.posexplode("distribution").alias("item_no", "e")).where("e.content_size_kb is not null")
    return a.select("identifier", "item_no", tx.kb_to_mb(F.col("e.content_size_kb")).alias("mb"), tx.kb_to_gb(F.col("e.content_size_kb")).alias("gb"))


@query(f"select identifier, cast(trunc(list_sum(list_transform(distribution, lambda e: coalesce(e.content_size_kb, 0) / 1024.0::double))) as bigint) as size_mb from {_ASSETS} where len(distribution) > 0")
def size_sums(spark, d):
    a = _assets(spark, d).where(F.size("distribution") > 0)
    return a.select("identifier", F.aggregate("distribution", F.lit(0.0), lambda s, e: s + F.coalesce(e["content_size_kb"], F.lit(0)) / F.lit(1024.0)).cast("long").alias("size_mb"))


_AT = "try_cast(regexp_replace(date_published, 'Z$', '') as timestamp)"


@query(f"select identifier, cast(year({_AT}) as int) as year, cast(month({_AT}) as int) as month, cast(day({_AT}) as int) as day, year({_AT}) || '-' || month({_AT}) || '-' || day({_AT}) as day_key from {_ASSETS} where {_AT} is not null")
def date_parts(spark, d):
    at = tx.parse_date(F.col("date_published"))
    a = _assets(spark, d).withColumn("_at", at).where("_at is not null")
    return a.select("identifier", F.year("_at").alias("year"), F.month("_at").alias("month"), F.dayofmonth("_at").alias("day"), tx.day_key(F.col("_at")).alias("day_key"))


@query(f"select identifier, strftime(date_trunc('day', coalesce({_AT}, timestamp '1970-01-01')), '%Y-%m-%d %H:%M:%S') as midnight from {_ASSETS}")
def parse_dates(spark, d):
    at = tx.parse_date(F.col("date_published"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return _assets(spark, d).select("identifier", F.date_format(F.date_trunc("day", at), "yyyy-MM-dd HH:mm:ss").alias("midnight"))


_KIND = lambda col, kind: f"list_sort(list_distinct(list_transform(list_filter({col}, lambda k: len(string_split(k, ':')) = 2 and string_split(k, ':')[1] = '{kind}'), lambda k: string_split(k, ':')[2])))"
_MADE = f"(select identifier, platform, date_published, distribution, list_concat(coalesce(keyword, []), ['language:' || platform, 'license:unknown', 'license:mit-' || platform, 'size_categories:10k<n<100k', 'task_ids:a:b', 'task_categories:' || type]) as kw from {_ASSETS})"


def _made(spark, d):
    """Catalogue keywords with coded ones added from the record's own columns, as a hub would deliver them."""
    a = _assets(spark, d)
    coded = F.array(F.concat(F.lit("language:"), "platform"), F.lit("license:unknown"), F.concat(F.lit("license:mit-"), "platform"), F.lit("size_categories:10k<n<100k"), F.lit("task_ids:a:b"), F.concat(F.lit("task_categories:"), "type"))
    return a.withColumn("kw", F.concat(F.coalesce("keyword", F.array().cast("array<string>")), coded))


@query(f"select identifier, array_to_string({_KIND('kw', 'language')}, ',') as languages, array_to_string(list_filter({_KIND('kw', 'license')}, lambda x: x <> 'unknown'), ',') as licences, array_to_string({_KIND('kw', 'task_ids')}, ',') as tasks from {_MADE}")
def keyword_extract(spark, d):
    kw = F.col("kw")
    return _made(spark, d).select("identifier", F.array_join(tx.keyword_values(kw, "language"), ",").alias("languages"), F.array_join(tx.strip_unknown(tx.keyword_values(kw, "license")), ",").alias("licences"), F.array_join(tx.keyword_values(kw, "task_ids"), ",").alias("tasks"))


_FAMILY = "case when contains(l, 'openrail') then 'openrail' " + " ".join(f"when starts_with(l, '{p}') then '{p}'" for p in sorted(tx.LICENCE_PREFIXES, key=lambda p: (-len(p), p))) + " end"


@query(f"""with v as (select distinct lower(license) as l from dataset_metadata where license is not null union select * from (values ('cc-by-nc-sa-4.0'), ('bigscience-openrail-m'), ('apache-2.0'), ('mit'), ('gpl-3.0'), ('agpl-3.0'), ('other'))) select l as licence, {_FAMILY} as family from v""")
def licence_simplify(spark, d):
    own = table(spark, d, "dataset_metadata").where("license is not null").select(F.lower("license").alias("licence"))
    more = spark.createDataFrame([(x,) for x in ("cc-by-nc-sa-4.0", "bigscience-openrail-m", "apache-2.0", "mit", "gpl-3.0", "agpl-3.0", "other")], "licence string")
    return own.union(more).distinct().select("licence", tx.simplify_licence(F.col("licence")).alias("family"))


@query("select distinct meta_id, case when datapoints_upper_bound is not null then datapoints_lower_bound end as lower_bound, case when datapoints_lower_bound is not null then datapoints_upper_bound end as upper_bound from dataset_metadata")
def size_categories(spark, d):
    """The bounds of each record written as a category (``10k<n<1m``) and read again."""
    def written(c):
        n = F.col(c)
        return F.when(n % 10**6 == 0, F.concat((n / 10**6).cast("long").cast("string"), F.lit("m"))).when(n % 10**3 == 0, F.concat((n / 10**3).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))

    bounds = tx.size_category(F.concat(written("datapoints_lower_bound"), F.lit("<n<"), written("datapoints_upper_bound")))
    rows = table(spark, d, "dataset_metadata").select("meta_id", bounds.alias("_b"))
    return rows.select("meta_id", F.col("_b.lower").alias("lower_bound"), F.col("_b.upper").alias("upper_bound")).distinct()


@query(f"""select identifier, date_published || 'Z' as date_published, cast(trunc(coalesce(list_sum(list_transform(distribution, lambda e: coalesce(e.content_size_kb, 0) / 1024.0::double)), 0)) as bigint) as size_in_mb,
  'mit' as license, type_task as task_types, platform as languages, 10000::bigint as datapoints_lower_bound, 100000::bigint as datapoints_upper_bound
  from (select *, array_to_string({_KIND('kw', 'task_categories')}, ',') as type_task from {_MADE}) where platform = 'opentabula'""")
def hub_metadata(spark, d):
    """Metadata of one hub's records from coded keywords; other platforms give none."""
    a = _made(spark, d).where("platform = 'opentabula'")
    kw = F.col("kw")
    bounds = tx.size_category(F.get(tx.strip_unknown(tx.keyword_values(kw, "size_categories")), F.lit(0)))
    mb = F.coalesce(F.aggregate("distribution", F.lit(0.0), lambda s, e: s + F.coalesce(e["content_size_kb"], F.lit(0)) / F.lit(1024.0)), F.lit(0.0)).cast("long")
    tasks = tx.strip_unknown(F.array_sort(F.array_union(tx.keyword_values(kw, "task_categories"), tx.keyword_values(kw, "task_ids"))))
    return a.select("identifier", F.concat("date_published", F.lit("Z")).alias("date_published"), mb.alias("size_in_mb"), tx.simplify_licences(tx.strip_unknown(tx.keyword_values(kw, "license"))).alias("license"), F.array_join(tasks, ",").alias("task_types"), F.array_join(tx.keyword_values(kw, "language"), ",").alias("languages"), bounds["lower"].alias("datapoints_lower_bound"), bounds["upper"].alias("datapoints_upper_bound"))


@query("select meta_id, case when languages is not null then coalesce(array_to_string(list_transform(languages, lambda x: lower(x)), ','), '') end as languages, cast(len(list_distinct(list_transform(languages, lambda x: lower(x)))) as int) as kept from (select distinct meta_id, languages from dataset_metadata)")
def lower_case_lists(spark, d):
    m = table(spark, d, "dataset_metadata").select("meta_id", "languages").distinct()
    low = F.transform("languages", F.lower)
    return m.select("meta_id", F.array_join(low, ",").alias("languages"), F.size(F.array_distinct(F.array_compact(low))).alias("kept")).withColumn("kept", F.when(F.col("languages").isNotNull(), F.col("kept")))


_TYPES = "(select unnest([" + ", ".join(f"'{t}'" for t in tx.ASSET_TYPES) + "]) as t, unnest(range(0, 13)) as i)"


@query(f"""with n as (select distinct lower(s) as s from (select lang as s from documents union all select event_type from events union all select type from assets union all select source from documents) where s is not null)
select s as name, first(t order by levenshtein(s, t), i) as closest from n, {_TYPES} group by s""")
def closest_asset_type(spark, d):
    docs, events, assets = _docs(spark, d), table(spark, d, "events"), table(spark, d, "assets")
    names = docs.select(F.col("lang").alias("s")).union(events.select("event_type")).union(assets.select("type")).union(docs.select("source"))
    return names.where("s is not null").select(F.lower("s").alias("name")).distinct().select("name", tx.closest_type(F.col("name")).alias("closest"))


_CATEGORY = "case type " + " ".join(f"when '{k}' then 'https://library.example/app/resources/' || identifier || '?category={v}'" for k, v in tx.LIBRARY_CATEGORIES.items())


@query(f"select distinct identifier, type, {_CATEGORY} when 'projects' then 'https://site.example/project/' || identifier when 'events' then 'https://site.example/media-hub/' || identifier when 'news' then 'https://site.example/media-hub/' || identifier when 'organisations' then 'https://eco.example/all' end as url from assets")
def asset_urls(spark, d):
    url = tx.asset_url(F.col("identifier"), F.col("type"), "https://site.example", "https://library.example/app/home", "https://eco.example/all")
    return table(spark, d, "assets").select("identifier", "type", url.alias("url")).distinct()


@query("select distinct identifier, regexp_full_match(identifier, '[a-z]{3,4}_[a-zA-Z0-9]{24}') as valid from assets")
def asset_id_check(spark, d):
    return table(spark, d, "assets").select("identifier", tx.is_asset_id(F.col("identifier")).alias("valid")).distinct()


_ALLOWED = "(select list(lower(value)) as allowed from field_valid_values where field = 'ml_tasks' and asset_type = 'base')"


@query(f"select meta_id, array_to_string(list_sort(list_distinct(list_filter(low, lambda x: list_contains(allowed, x)))), ',') as valid, array_to_string(list_sort(list_distinct(list_filter(low, lambda x: not list_contains(allowed, x)))), ',') as invalid from (select distinct meta_id, list_transform(task_types, lambda x: lower(x)) as low from dataset_metadata where task_types is not null), {_ALLOWED}")
def valid_value_split(spark, d):
    m = table(spark, d, "dataset_metadata").where("task_types is not null").select("meta_id", F.array_compact(F.transform("task_types", F.lower)).alias("low")).distinct()
    allowed = table(spark, d, "field_valid_values").where("field = 'ml_tasks' and asset_type = 'base'").agg(F.collect_set(F.lower("value")).alias("allowed"))
    both = m.join(allowed, F.lit(True))  # one row: the list of allowed values
    show = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select("meta_id", show(F.array_intersect("low", "allowed")).alias("valid"), show(F.array_except("low", "allowed")).alias("invalid"))


@query("""with t as (select distinct asset_type from field_valid_values where asset_type <> 'base'), f as (select distinct field from field_valid_values)
select t.asset_type, f.field, string_agg(distinct lower(v.value), ',' order by lower(v.value)) as allowed from t, f, field_valid_values v where v.field = f.field and v.asset_type in ('base', t.asset_type) group by 1, 2""")
def valid_value_merge(spark, d):
    v = table(spark, d, "field_valid_values").select("asset_type", "field", F.lower("value").alias("value"))
    own = v.where("asset_type <> 'base'")
    types = own.select("asset_type").distinct()
    base = v.where("asset_type = 'base'").drop("asset_type").join(types, F.lit(True))  # asset types are a fixed list
    return base.unionByName(own).groupBy("asset_type", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("allowed"))


@query("with f as (select distinct encoding_format as e from (select unnest(distribution).encoding_format as encoding_format from assets) where e is not null) select array_to_string(list_filter(list_transform(string_split(lower(' ' || string_agg(e, ' , ' order by e) || ', ,'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as formats from f")
def csv_values(spark, d):
    e = table(spark, d, "assets").select(F.explode("distribution").alias("x")).select(F.col("x.encoding_format").alias("e")).where("e is not null").distinct()
    text = e.agg(F.concat(F.lit(" "), F.array_join(F.array_sort(F.collect_set("e")), " , "), F.lit(", ,")).alias("t"))
    return text.select(F.array_join(tx.csv_values(F.col("t")), "|").alias("formats"))


@query("select distinct 'lw_' || asset_type as collection, regexp_full_match('lw_' || asset_type, '[A-Za-z_][A-Za-z0-9_]*') as valid, regexp_extract('lw_' || asset_type, '^lw_(.*)$', 1) as asset_type from chunk_vectors where asset_type is not null")
def collection_names(spark, d):
    t = table(spark, d, "chunk_vectors").where("asset_type is not null").select("asset_type").distinct()
    name = F.concat(F.lit("lw_"), "asset_type")
    return t.select(name.alias("collection"), F.rlike(name, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")).alias("valid"), F.regexp_extract(name, "^lw_(.*)$", 1).alias("asset_type"))


@query("select l || '-' || q as kind from (select unnest(['least', 'moderately', 'well']) as l), (select distinct source as q from source_weights)")
def query_kinds(spark, d):
    levels = F.explode(F.array(*map(F.lit, ("least", "moderately", "well"))))
    return table(spark, d, "source_weights").select("source", levels.alias("l")).select(F.concat("l", F.lit("-"), "source").alias("kind"))


@query(f"select identifier, bucket from (select identifier, case when n > 1000 and k > 3 then 'long_many' when n > 1000 and k < 3 then 'long_few' when n between 200 and 500 and k > 3 then 'short_many' when n < 50 and k > 3 then 'tiny_many' end as bucket from (select identifier, coalesce(length({_TEXT('description')}), 0) as n, coalesce(len(keyword), 0) as k from {_ASSETS})) where bucket is not null")
def quality_buckets(spark, d):
    a = _assets(spark, d)
    n = F.coalesce(F.length(tx.text_of(F.col("description"))), F.lit(0))
    k = F.greatest(F.coalesce(F.size("keyword"), F.lit(0)), F.lit(0))
    # The catalogue's records have few keywords, so a tag here counts for three.
    tags = F.when(k > 3, 11).when(k < 3, 0).otherwise(5)
    return a.select("identifier", evaluate.quality_bucket(n, tags).alias("bucket")).where("bucket is not null")


_CONDS = "(select identifier, [{'mandatory': true, 'met': name is not null}, {'mandatory': true, 'met': coalesce(len(keyword), 0) > 0}, {'mandatory': false, 'met': date_published is not null}, {'mandatory': false, 'met': coalesce(len(distribution), 0) > 0}, {'mandatory': platform = 'robohub', 'met': note is not null}] as c from assets where platform is not null)"
_N = lambda test: f"len(list_filter(c, lambda x: {test}))::double"


@query(f"select distinct identifier, round({_N('x.mandatory and x.met')} / {_N('x.mandatory')} + coalesce({_N('not x.mandatory and x.met')} / nullif({_N('not x.mandatory')}, 0), 0) * power({_N('x.mandatory and x.met')} / {_N('x.mandatory')}, 2), 6) as score from {_CONDS}")
def heuristic_score(spark, d):
    a = table(spark, d, "assets").where("platform is not null")
    c = lambda must, met: F.struct(must.alias("mandatory"), met.alias("met"))
    some = lambda n: F.coalesce(F.size(n), F.lit(0)) > 0
    conditions = F.array(c(F.lit(True), F.col("name").isNotNull()), c(F.lit(True), some("keyword")), c(F.lit(False), F.col("date_published").isNotNull()), c(F.lit(False), some("distribution")), c(F.col("platform") == "robohub", F.col("note").isNotNull()))
    return a.select("identifier", F.round(evaluate.heuristic_score(conditions), 6).alias("score")).distinct()


@query("select distinct identifier from assets where name is not null and trim(name) <> '' and len(coalesce(description.plain, description.html)) > 0 and len(keyword) > 0 and platform = 'opentabula'")
def good_assets(spark, d):
    a = table(spark, d, "assets")
    text = F.coalesce(F.col("description.plain"), F.col("description.html"))
    return a.where((F.trim("name") != "") & (F.length(text) > 0) & (F.size("keyword") > 0) & (F.col("platform") == "opentabula")).select("identifier").distinct()


_KEEP = lambda k, test: f"case when {test} then '{k}' end"


@query(f"select distinct identifier, concat_ws(',', {_KEEP('date_published', 'length(date_published) > 0')}, {_KEEP('keyword', 'len(keyword) > 0')}, {_KEEP('name', 'length(name) > 0')}, {_KEEP('note', 'len(note) > 0')}, {_KEEP('platform', 'length(platform) > 0')}) as kept from assets")
def drop_empty_fields(spark, d):
    a = table(spark, d, "assets")
    full = lambda c, n: F.when(n(c) > 0, F.lit(c))
    return a.select("identifier", F.concat_ws(",", full("date_published", F.length), full("keyword", F.size), full("name", F.length), full("note", F.size), full("platform", F.length)).alias("kept")).distinct()


@query()
def embed_documents(spark, d):
    return embedding.embed_chunks(_docs(spark, d), "doc_id", "text", hash_embedding(64), SIZE, OVERLAP, cap=None)


@query()
def pooled_document_vectors(spark, d):
    return evaluate.pooled_vectors(embed_documents(spark, d), "mean", "doc_id", "chunk_no")


@query("""select event_id, 'act_' || event_type as name, '{"k": ' || (json_extract_string(props, '$.k')) || '}' as arguments from events where json_extract_string(props, '$.k') is not null""")
def function_calls(spark, d):
    e = table(spark, d, "events")
    said = F.concat(F.lit("I will call <function=act_"), "event_type", F.lit(">"), "props", F.lit("</function> now"))
    return e.select("event_id", tx.function_call(said).alias("c")).where("c is not null").select("event_id", "c.name", "c.arguments")


@query("""with a as (select identifier, unnest(range(0, len(distribution))) as attempt, unnest(distribution) as e, len(distribution) as n from (select distinct identifier, distribution from assets)),
v as (select identifier, attempt, (e.description is not null)::int + (e.content_size_kb is not null)::int + (e.name is not null)::int as valid, 3 as total from a)
select identifier, cast(attempt as int) as attempt, valid from (select *, row_number() over (partition by identifier order by (valid = total) desc, case when valid = total then 0 else -valid end, attempt) as r from v) where r = 1""")
def best_attempt(spark, d):
    a = table(spark, d, "assets").select("identifier", "distribution").distinct().select("identifier", F.posexplode("distribution").alias("attempt", "e"))
    ok = sum(F.col(f"e.{c}").isNotNull().cast("int") for c in ("description", "content_size_kb", "name"))
    return evaluate.best_attempt(a.select("identifier", "attempt", ok.alias("valid"), F.lit(3).alias("total")), "identifier", "valid", "total", "attempt").select("identifier", "attempt", "valid")


@query("select meta_id, array_to_string(list_concat([coalesce(license, 'any')], list_filter(coalesce(task_types, []), lambda x: x is not null and x <> '')), ' ') as topic from (select distinct meta_id, license, task_types from dataset_metadata)")
def topic_expansion(spark, d):
    m = table(spark, d, "dataset_metadata").select("meta_id", "license", "task_types").distinct()
    return m.select("meta_id", evaluate.expand_topic(F.coalesce("license", F.lit("any")), F.coalesce("task_types", F.array().cast("array<string>"))).alias("topic"))


@query("""with v as (select distinct lower(trim(original_value)) as value from normalized_values where field = 'ml_tasks' and original_value is not null),
a as (select distinct lower(value) as allowed from field_valid_values where field = 'ml_tasks' and asset_type = 'base'),
m as (select v.value, a.allowed, levenshtein(v.value, a.allowed) as edits from v, a where levenshtein(v.value, a.allowed) <= 2),
b as (select *, row_number() over (partition by value order by edits, allowed) as r from m)
select v.value, b.allowed as normalised, cast(b.edits as int) as edits from v left join b on b.value = v.value and b.r = 1""")
def value_normalisation(spark, d):
    values = table(spark, d, "normalized_values").where("field = 'ml_tasks'")
    allowed = table(spark, d, "field_valid_values").where("field = 'ml_tasks' and asset_type = 'base'").select(F.col("value").alias("allowed"))
    return normalise.to_allowed(values, allowed, "original_value")


@query()
def embed_whole_documents(spark, d):
    return embedding.embed_whole(_docs(spark, d), "doc_id", "text", hash_embedding(64), most_tokens=None)
