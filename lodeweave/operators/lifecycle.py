"""Query log: order of work, status, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import store

#: The states a query goes through.
QUEUED, IN_PROGRESS, COMPLETED, FAILED = "Queued", "In_progress", "Completed", "Failed"


def status_of(text: Column) -> Column:
    """One spelling of a status; null for anything else."""
    folded = F.regexp_replace(F.lower(F.trim(text)), r"[\s\-_]+", "_")
    out = None
    for s in (QUEUED, IN_PROGRESS, COMPLETED, FAILED):
        out = F.when(folded == s.lower(), s) if out is None else out.when(folded == s.lower(), s)
    return out


def open_queries(log: DataFrame) -> DataFrame:
    """Queries to take up again, those already begun first, then by last change."""
    work = log.where(status_of(F.col("status")).isin(QUEUED, IN_PROGRESS))
    return work.orderBy(status_of(F.col("status")) != IN_PROGRESS, "updated_at", "query_id")


def expires_at(status: Column, updated: Column, minutes: int) -> Column:
    """When a finished query's result may be deleted; null while it is not finished."""
    return F.when(status_of(status).isin(COMPLETED, FAILED), updated + F.expr(f"INTERVAL {minutes} MINUTES"))


def is_expired(expires: Column, now: Column) -> Column:
    return expires.isNotNull() & (expires < now)


def conversation(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, place, role, text): each conversation's messages as rows in order, however many they are."""
    return store.number_within(messages.select(key, order, "role", "text"), key, [order]).select(key, "place", "role", "text")
