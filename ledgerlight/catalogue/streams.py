"""Queries over state: sessions, windows, deduplication; in batch form with SQL, and as streams that end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state as S
from .registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("select user_id, event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over w as purchase, last_value(case when event_type = 'view' then value end ignore nulls) over w as view from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")
def q95_session_profile(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in ("purchase", "view")])
    return S.carried(e, ["user_id"], ["ts", "event_id"], ["purchase", "view"]).drop("ts")


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def q96_tumbling(spark, sf_dir):
    return S.windows(_events(spark, sf_dir), "1 day").select(F.col("window.start").alias("day"), "event_type", "n", "total")


@query("with s as (select *, case when ts <= lag(ts) over w + interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from s) select user_id, min(ts) as began, count(*) as n from g group by user_id, g")
def q97_sessions(spark, sf_dir):
    s = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("began"))
    return s.select("user_id", "began", "n")


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2 having date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events)")
def q98_stream_windows(spark, sf_dir):
    return S.stream_windows(spark, f"{sf_dir}/events.parquet", "1 day", "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("select count(*) as n from (select distinct user_id, event_type from events)")
def q99_stream_distinct(spark, sf_dir):
    return S.stream_distinct(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"]).agg(F.count("*").alias("n"))


@query("select user_id, count(*) as n, max(event_id) as last_id from events group by user_id")
def q9a_stream_memory(spark, sf_dir):
    return S.stream_memory(spark, f"{sf_dir}/events.parquet")


@query("select bucket - to_hours(cast(6 * k as int)) as start, event_type, count(*) as n, round(sum(value), 4) as total from (select *, time_bucket(interval 6 hours, ts) as bucket, unnest(range(0, 4)) as k from events) group by 1, 2")
def q9b_sliding(spark, sf_dir):
    return S.windows(_events(spark, sf_dir), "1 day", slide="6 hours").select("window.start", "event_type", "n", "total")


@query("""with recursive e as (select 'v3.4:' || event_type || ':' || user_id % 40 as key, cast(floor(epoch(ts)) as bigint) as sec, row_number() over (partition by event_type, user_id % 40 order by floor(epoch(ts))) as k from events),
w as (select key, k, sec as since, 0 as hit from e where k = 1 union all select e.key, e.k, case when e.sec - w.since < 21600 then w.since else e.sec end, case when e.sec - w.since < 21600 then 1 else 0 end from w join e on e.key = w.key and e.k = w.k + 1)
select key, cast(sum(hit) as bigint) as hits, cast(sum(1 - hit) as bigint) as misses from w group by 1""")
def q9c_stream_cache(spark, sf_dir):
    return S.stream_cache(spark, f"{sf_dir}/events.parquet")
