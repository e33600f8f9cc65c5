"""Relational operators over the star-schema tables: joins, aggregates, windows, sets, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..plans import relational as P
from .registry import query, table


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def q75_pricing_summary(spark, sf_dir):
    (li,) = _t(spark, sf_dir, "lineitem")
    return li.filter("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("select n_name, r_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def q76_star_join(spark, sf_dir):
    o, c, n, r = _t(spark, sf_dir, "orders", "customer", "nation", "region")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))  # reduced before the join
    j = per.join(c, "c_custkey").join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("n_name", "r_name").agg(F.sum("k").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def q77_semi(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def q78_anti(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("select coalesce(a.k, b.k) as k, a.n as customers, b.n as suppliers from (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by 1) a full outer join (select s_nationkey as k, count(*) as n from supplier group by 1) b on a.k = b.k")
def q79_full_outer(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    a = c.filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full_outer")


_GROUP = "p_brand, p_size, count(*) as n, grouping(p_brand) as gb, grouping(p_size) as gs from part group by"


@query(f"select {_GROUP} cube (p_brand, p_size)")
def q80_cube(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "part")
    return p.cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.grouping("p_brand").cast("bigint").alias("gb"), F.grouping("p_size").cast("bigint").alias("gs"))


@query(f"select {_GROUP} rollup (p_brand, p_size)")
def q81_rollup(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "part")
    return p.rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.grouping("p_brand").cast("bigint").alias("gb"), F.grouping("p_size").cast("bigint").alias("gs"))


@query("select p_brand, p_type, count(*) as n from part group by grouping sets ((p_brand), (p_type), ())")
def q82_grouping_sets(spark, sf_dir):
    return spark.sql("select p_brand, p_type, count(*) as n from {part} group by grouping sets ((p_brand), (p_type), ())", part=table(spark, sf_dir, "part"))


@query("select o_custkey, o_orderkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, lag(o_totalprice) over w as prev, lead(o_totalprice) over w as next, ntile(4) over w as quart, round(percent_rank() over w, 6) as pr, round(sum(o_totalprice) over (w rows between 2 preceding and current row), 2) as run from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def q83_windows(spark, sf_dir):
    (o,) = _t(spark, sf_dir, "orders")
    w = W.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rn"), F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_totalprice").over(w).alias("next"), F.ntile(4).over(w).cast("bigint").alias("quart"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("run"))


@query("select p_type, p_partkey, p_retailprice from (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as r from part) where r <= 3")
def q84_topk_per_group(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "part")
    w = W.Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_type", "p_partkey", "p_retailprice")


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def q85_intersect(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("select l_returnflag as f from lineitem except all select o_orderstatus from orders")
def q86_except_all(spark, sf_dir):
    li, o = _t(spark, sf_dir, "lineitem", "orders")
    return li.select(F.col("l_returnflag").alias("f")).exceptAll(o.select("o_orderstatus"))


@query("select e.event_id, e.user_id, (select max(v.ts) from events v where v.user_id = e.user_id and v.event_type = 'view' and v.ts <= e.ts) as seen from events e where e.event_type = 'purchase'")
def q87_asof(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return P.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen")), "user_id", "ts", "seen").select("event_id", "user_id", "seen")


@query("select p.event_id, count(c.event_id) as clicks from events p left join events c on c.user_id = p.user_id and c.event_type = 'click' and c.ts between p.ts - interval 1 day and p.ts where p.event_type = 'purchase' group by 1")
def q88_interval_join(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    c = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("click"))
    return P.within(e.filter("event_type = 'purchase'"), c, "user_id", "ts", "at", 86400).groupBy("event_id").agg(F.count("click").alias("clicks"))


@query("select p_size, count(distinct p_brand) as brands, count(distinct p_type) as types, count(*) filter (p_retailprice > 1000) as dear from part group by 1")
def q89_distinct_counts(spark, sf_dir):
    (p,) = _t(spark, sf_dir, "part")
    return p.groupBy("p_size").agg(F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_type").alias("types"), F.count_if(F.col("p_retailprice") > 1000).alias("dear"))


@query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n, round(sum(value), 4) as total from events group by 1")
def q90_json(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    return e.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("pivot (select user_id % 50 as u, event_type from events) on event_type in ('click', 'error', 'purchase', 'signup', 'view') using count(*) group by u")
def q91_pivot(spark, sf_dir):
    (e,) = _t(spark, sf_dir, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return e.groupBy((F.col("user_id") % 50).alias("u")).pivot("event_type", kinds).count().fillna(0, kinds)


@query("select lower(name) as name, cast(sum(n) as bigint) as n from (select n_name as name, 1 as n from nation union all select r_name, 2 from region) group by 1")
def q92_union_all(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation", "region")
    both = n.select(F.col("n_name").alias("name"), F.lit(1).alias("n")).unionByName(r.select(F.col("r_name").alias("name"), F.lit(2).alias("n")))
    return both.groupBy(F.lower("name").alias("name")).agg(F.sum("n").alias("n"))


@query("select a.l_returnflag, abs(parts - exact) <= 0.15 * exact as parts_near, median_qty = exact_median as median_near from (select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_partkey) as exact, quantile_disc(l_quantity, 0.5) as median_qty, quantile_disc(l_quantity, 0.5) as exact_median from lineitem group by 1) a")
def q93_approximate(spark, sf_dir):
    """Sketches against exact values: a count of distinct parts within three deviations, a median."""
    (li,) = _t(spark, sf_dir, "lineitem")
    # beside a distinct count Spark would hold every aggregate, sketches too, for each flag and part
    exact = li.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("exact"))
    rest = li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.05).alias("parts"), F.percentile_approx("l_quantity", 0.5, 100000).alias("median"), F.expr("percentile_disc(0.5) within group (order by l_quantity)").alias("exact_median"))
    both = rest.unionByName(exact, allowMissingColumns=True)  # not a join, which would lose a flag that is null
    g = both.groupBy("l_returnflag").agg(*[F.max(c).alias(c) for c in ("parts", "exact", "median", "exact_median")])
    return g.select("l_returnflag", (F.abs(F.col("parts") - F.col("exact")) <= 0.15 * F.col("exact")).alias("parts_near"), (F.col("median") == F.col("exact_median")).alias("median_near"))


_RANGE = "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate range between interval {} preceding and current row), 2) as month from {}"


@query(_RANGE.format("30 day", "orders"))
def q94_range_frame(spark, sf_dir):
    """SQL text over a view: a frame by time, not by rows."""
    (o,) = _t(spark, sf_dir, "orders")
    o.createOrReplaceTempView("orders_by_time")
    return spark.sql(_RANGE.format("'30' day", "orders_by_time"))


@query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(12, 2)) * cast(l_discount as decimal(4, 2))) as varchar) as off, cast(max(l_quantity) as bigint) as most, cast(epoch(max(l_shipdate)) - epoch(min(l_shipdate)) as bigint) as seconds, count(*) filter (l_linestatus = 'O') as open from lineitem group by 1")
def q9d_types(spark, sf_dir):
    """Decimals, intervals and maps."""
    (li,) = _t(spark, sf_dir, "lineitem")
    per = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")).alias("off"), F.max("l_quantity").alias("most"), F.max("l_shipdate").alias("z"), F.min("l_shipdate").alias("a"))
    by = F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n")))  # a few states
    g = per.groupBy("l_returnflag").agg(by.alias("by"), F.sum("off").alias("off"), F.max("most").alias("most"), (F.max("z") - F.min("a")).alias("gap"))
    return g.select("l_returnflag", F.col("off").cast("decimal(38,4)").cast("string").alias("off"), F.col("most").cast("bigint").alias("most"), (F.extract(F.lit("DAY"), "gap") * 86400 + F.extract(F.lit("HOUR"), "gap") * 3600 + F.extract(F.lit("MINUTE"), "gap") * 60 + F.extract(F.lit("SECOND"), "gap")).cast("bigint").alias("seconds"), F.coalesce(F.try_element_at("by", F.lit("O")), F.lit(0)).alias("open"))
