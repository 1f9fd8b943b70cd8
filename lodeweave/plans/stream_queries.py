"""Queries that run a stream to its end and give what it wrote."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lodeweave.plans.registry import query
from lodeweave.runtime import table
from lodeweave.sources.catalogue import paged
from lodeweave.streaming import ingest as si
from lodeweave.streaming import resume


@query("select event_type, count(distinct event_id) as n, round(sum(value), 4) as total from (select distinct event_id, event_type, value from events) group by 1")
def stream_dedup(spark, d):
    out = si.deduplicated(spark, d, "events", "event_id", "ts", "60 days")
    return out.groupBy("event_type").agg(F.count("event_id").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windows(spark, d):
    out = si.windowed(spark, d, "events", "ts", "1 day", ["event_type"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


@query("""select query_id, arg_max(case replace(lower(trim(status)), ' ', '_') when 'queued' then 'Queued' when 'in_progress' then 'In_progress' when 'completed' then 'Completed' when 'failed' then 'Failed' end, updated_at) as status, count(*) as changes from (select distinct query_id, status, updated_at from search_results) group by query_id""")
def stream_query_status(spark, d):
    return si.latest_status(spark, d)


@query("select identifier as asset_id, count(*) as version from (select distinct identifier, harvested_at from assets) group by 1")
def stream_versions(spark, d):
    return si.versioned(spark, d)


@query()
def paged_scan(spark, d):
    total = table(spark, d, "assets").count()
    return paged(spark, f"lodeweave.sources.catalogue:asset_rows?{d}/assets.parquet", "id string, platform string, name string", total=total, limit=1000, overlap=0.1)


@query("select identifier as asset_id, count(distinct harvested_at) as deliveries, strftime(max(harvested_at), '%Y-%m-%d %H:%M:%S') as last from assets where identifier is not null and harvested_at < timestamp '2030-01-01' group by 1")
def resumable_ingest(spark, d):
    """The catalogue in windows, in two spans; the first run breaks off within its second window, the next goes on there."""
    folder = si.shared_folder(spark)
    deliveries = table(spark, d, "assets").select(F.col("identifier").alias("asset_id"), "harvested_at").distinct()
    middle = dt.datetime(2022, 1, 1)
    runs = []

    def apply(rows):
        runs.append(1)
        if len(runs) == 2:
            raise ConnectionError
        rows.write.mode("overwrite").parquet(f"{folder}/out/window={len(runs)}")

    window = -(-deliveries.count() // 4)
    for until in (middle, middle, dt.datetime(2030, 1, 1)):
        try:
            resume.ingest(deliveries, "asset_id", "harvested_at", resume.Progress(spark, f"{folder}/progress"), apply, window, until)
        except ConnectionError:
            continue
    out = spark.read.schema(deliveries.schema).parquet(f"{folder}/out")
    return out.groupBy("asset_id").agg(F.countDistinct("harvested_at").alias("deliveries"), F.date_format(F.max("harvested_at"), "yyyy-MM-dd HH:mm:ss").alias("last"))
