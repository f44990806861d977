"""The batch form of the streaming counts."""

from __future__ import annotations

from lathework.functions.columns import r6
from lathework.plans.base import Registry, r
from lathework.session import table
from lathework.streaming.incremental import windowed_counts

query = Registry()


@query("windowed_counts", f"select date_trunc('hour', ts) as start, user_id as sample_id, event_type as feature_id, count(*) as n, {r('sum(value)')} as total from events group by 1, 2, 3")
def windowed(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("total", r6("total"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
