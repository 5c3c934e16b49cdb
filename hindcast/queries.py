"""Registered queries of the library's operators, each over whole tables, with the SQL that states the same result."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions import questions
from hindcast.operators import agreement, audit, backtest, database, features, labels, live, predict, profile, relations, taskforms, timeline
from hindcast.operators.anchors import anchor_table, in_future
from hindcast.operators.ranks import roc_auc, value_ranks
from hindcast.operators.spec import Filter, LabelSpec, anchors_before, baseline_anchors, task_manifest
from hindcast.plans import readings
from hindcast.sources import tables as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LAST = datetime(2001, 1, 1)
ANCHORS = anchors_before(LAST, 90, 6)
TRAIN = anchors_before(datetime(2000, 10, 3), 90, 5)


# Columns that hold times are returned as text by queries and SQL alike, for engines differ in the units of times.


def query(name: str, sql: str | None = None, times: tuple[str, ...] = ()):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})

        QUERIES[name] = run
        if sql:
            as_text = ", ".join(f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S') AS \"{c}\"" for c in times)
            ORACLES[name] = f"SELECT * REPLACE ({as_text}) FROM ({sql})" if times else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, for sums of doubles depend on their order."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def anchors_sql(anchors: list[datetime]) -> str:
    return "(SELECT unnest([" + ", ".join(f"TIMESTAMP '{a:%Y-%m-%d %H:%M:%S}'" for a in anchors) + "]) AS t)"


# ---------------------------------------------------------------- labels (L)

CUSTOMER = LabelSpec("customer", "c_custkey", "orders", "o_custkey", "o_orderdate", "not_exists", 90, "recent")
PRICE = Filter("o_totalprice", ">=", 200000.0)


def label_sql(spec: LabelSpec, anchors: list[datetime]) -> str:
    """The label of a spec as SQL over joins on the window's inequality."""
    days = f"INTERVAL {spec.horizon_days} DAY"
    window = f"e.{spec.time} > a.t AND e.{spec.time} <= a.t + {days}"
    cond = "TRUE" if spec.filter is None else f"e.{spec.filter.column} {spec.filter.op} " + (f"'{spec.filter.value}'" if isinstance(spec.filter.value, str) else str(spec.filter.value))
    value = f"e.{spec.value}"
    above = "" if spec.threshold is None else f" > {spec.threshold}"
    if spec.population == "in_window":
        agg = {
            "exists": f"CAST(max(CASE WHEN {cond} THEN 1 ELSE 0 END) AS INTEGER)",
            "count": f"CAST((count(*) FILTER (WHERE {cond})){above} AS {'INTEGER' if above else 'BIGINT'})",
            "sum": f"round(sum(CASE WHEN {cond} THEN {value} ELSE 0 END), 6)",
            "mean": f"round(avg({value}) FILTER (WHERE {cond}), 6)",
        }[spec.op]
        having = " HAVING target IS NOT NULL" if spec.op == "mean" else ""
        return f"SELECT a.t AS timestamp, e.{spec.link} AS {spec.entity_key}, {agg} AS target FROM {anchors_sql(anchors)} a JOIN {spec.event} e ON {window} WHERE e.{spec.link} IS NOT NULL GROUP BY 1, 2{having}"
    who = f"SELECT a.t, x.{spec.entity_key} AS k FROM {anchors_sql(anchors)} a, {spec.entity} x"
    if spec.population == "recent":
        who += f" WHERE EXISTS (SELECT 1 FROM {spec.event} e WHERE e.{spec.link} = x.{spec.entity_key} AND e.{spec.time} > a.t - INTERVAL {spec.past_days} DAY AND e.{spec.time} <= a.t)"
    target = {"not_exists": "CAST(h.n IS NULL AS INTEGER)", "exists": "CAST(h.n IS NOT NULL AS INTEGER)", "count": f"CAST(coalesce(h.n, 0){above} AS {'INTEGER' if above else 'BIGINT'})", "sum": "round(coalesce(h.s, 0), 6)"}[spec.op]
    total = f"sum({value})" if spec.value else "0"
    return f"WITH p AS ({who}), h AS (SELECT a.t, e.{spec.link} AS k, count(*) AS n, {total} AS s FROM {anchors_sql(anchors)} a JOIN {spec.event} e ON {window} AND {cond} GROUP BY 1, 2) SELECT p.t AS timestamp, p.k AS {spec.entity_key}, {target} AS target FROM p LEFT JOIN h USING (t, k)"


def label_query(name: str, spec: LabelSpec, anchors: list[datetime] = ANCHORS) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(labels.compile_labels(spec, {t: table(spark, sf_dir, t) for t in (spec.entity, spec.event)}, anchors), 6)

    query(name, label_sql(spec, anchors), ("timestamp",))(run)


PART = LabelSpec("part", "p_partkey", "lineitem", "l_partkey", "l_shipdate", "count", 30, "all")
label_query("l01_not_exists_all", CUSTOMER.but(population="all"))
label_query("l02_not_exists_recent", CUSTOMER)
label_query("l03_exists_all", CUSTOMER.but(op="exists", population="all", filter=PRICE))
label_query("l04_exists_recent", CUSTOMER.but(op="exists"))
label_query("l05_exists_in_window", CUSTOMER.but(op="exists", population="in_window", filter=PRICE))
label_query("l06_count_all", PART, anchors_before(LAST, 30, 4))
label_query("l06_count_recent", CUSTOMER.but(op="count"))
label_query("l07_count_in_window", CUSTOMER.but(op="count", population="in_window"))
label_query("l07_count_in_window_filtered", CUSTOMER.but(op="count", population="in_window", filter=PRICE))
label_query("l08_threshold_all", CUSTOMER.but(op="count", population="all", threshold=1.0))
label_query("l08_threshold_recent", CUSTOMER.but(op="count", threshold=1.0))
label_query("l08_threshold_in_window", CUSTOMER.but(op="count", population="in_window", threshold=1.0))
label_query("l09_sum_all", CUSTOMER.but(op="sum", population="all", value="o_totalprice"))
label_query("l09_sum_recent", CUSTOMER.but(op="sum", value="o_totalprice", filter=Filter("o_orderstatus", "=", "F")))
label_query("l10_sum_in_window", CUSTOMER.but(op="sum", population="in_window", value="o_totalprice", filter=PRICE))
label_query("l11_mean_in_window", CUSTOMER.but(op="mean", population="in_window", value="o_totalprice", filter=PRICE))
label_query("l13_lookback", CUSTOMER.but(lookback_days=200))
label_query("l13_overlapping_windows", CUSTOMER.but(op="count", horizon_days=200, lookback_days=45))

COMPARISONS = [Filter("o_totalprice", "<", 50000.0), Filter("o_totalprice", "<=", 50000.0), Filter("o_totalprice", ">", 300000.0), Filter("o_totalprice", ">=", 300000.0), Filter("o_orderstatus", "=", "O"), Filter("o_orderstatus", "!=", "O")]


@query("l12_event_filters", "SELECT o_custkey, " + ", ".join(f"CAST(count(*) FILTER (WHERE {f.column} {f.op} {f.value!r}) AS BIGINT) AS f{i}" for i, f in enumerate(COMPARISONS)) + " FROM orders GROUP BY 1")
def l12(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(*(F.count(F.when(f.on(), 1)).alias(f"f{i}") for i, f in enumerate(COMPARISONS)))


@query("l15_live_population", "SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-01-01' - INTERVAL 90 DAY AND o_orderdate <= TIMESTAMP '2001-01-01' AND o_custkey IS NOT NULL")
def l15(spark, d):
    return labels.live_population(CUSTOMER, table(spark, d, "customer"), table(spark, d, "orders"), LAST)


# ---------------------------------------------------------------- time (A)

DAILY = "WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day), v AS (SELECT day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM s LEFT JOIN c USING (day)), w AS (SELECT *, CAST(sum(n) OVER (ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS week FROM v) "


@query("a01_daily_volume", DAILY + "SELECT day, n FROM v", ("day",))
def a01(spark, d):
    return timeline.daily_volume(table(spark, d, "orders"), "o_orderdate")


@query("a02_weekly_volume", DAILY + "SELECT day, n, week FROM w", ("day",))
def a02(spark, d):
    return timeline.weekly_volume(timeline.daily_volume(table(spark, d, "orders"), "o_orderdate"))


SPLIT = ", m AS (SELECT median(week) AS typical FROM w WHERE week > 0), x AS (SELECT min(day) AS first_day, any_value(typical) AS typical, coalesce(max(day) FILTER (WHERE week >= 0.25 * typical), max(day)) AS end_day FROM w, m)"


@query("a03_split", DAILY.rstrip() + SPLIT + " SELECT first_day, typical, end_day, end_day - 90 AS test_day, end_day - 180 AS val_day, end_day - 450 >= first_day AS enough FROM x", ("first_day", "end_day", "test_day", "val_day"))
def a03(spark, d):
    return timeline.split_table(table(spark, d, "orders"), "o_orderdate", 90)


@query("a04_anchors", DAILY.rstrip() + SPLIT + " SELECT CAST(end_day - CAST(90 + 90 * i AS INTEGER) AS TIMESTAMP) AS timestamp FROM x, range(4) r(i)", ("timestamp",))
def a04(spark, d):
    _, test = timeline.choose_splits(table(spark, d, "orders"), "o_orderdate", 90)
    return anchor_table(spark, anchors_before(test, 90, 4))


@query("a05_baseline_anchors", DAILY.rstrip() + SPLIT + " SELECT CAST(end_day - CAST(270 + 90 * i AS INTEGER) AS TIMESTAMP) AS timestamp FROM x, range(60) r(i) WHERE CAST(end_day - CAST(360 + 90 * i AS INTEGER) AS TIMESTAMP) >= (SELECT min(o_orderdate) FROM orders)", ("timestamp",))
def a05(spark, d):
    orders = table(spark, d, "orders")
    val, _ = timeline.choose_splits(orders, "o_orderdate", 90)
    return anchor_table(spark, baseline_anchors(val, 90, relations.time_range(orders, "o_orderdate").first()["first"]))


# ---------------------------------------------------------------- task forms (X)


def window_sql(source: str, key: str, time: str, target: str, anchors: list[datetime], horizon: int, more: str = "") -> str:
    return f"SELECT a.t AS timestamp, {key} AS key, {target} AS target FROM {anchors_sql(anchors)} a JOIN {source} ON {time} > a.t AND {time} <= a.t + INTERVAL {horizon} DAY WHERE {key} IS NOT NULL GROUP BY 1, 2{more}"


def orders_window(spark, d, target, having=None):
    return rounded(taskforms.window_labels(table(spark, d, "orders"), "o_custkey", "o_orderdate", ANCHORS, 90, target, having), 6)


@query("x01_set_filter_count", window_sql("orders", "o_custkey", "o_orderdate", "CAST(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT)", ANCHORS, 90), ("timestamp",))
def x01(spark, d):
    return orders_window(spark, d, F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)))


@query("x02_conditional_count_above", window_sql("orders", "o_custkey", "o_orderdate", "CAST(count(*) FILTER (WHERE o_orderstatus = 'F') > 1 AS INTEGER)", ANCHORS, 90), ("timestamp",))
def x02(spark, d):
    return orders_window(spark, d, (F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) > 1).cast("int"))


X03 = window_sql("orders", "o_custkey", "o_orderdate", "CAST(count(*) FILTER (WHERE o_orderstatus = 'O') > 0 AS INTEGER)", ANCHORS, 90)


@query("x03_repeat_population", f"SELECT timestamp, key, target FROM (SELECT *, max(target) OVER (PARTITION BY key ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b FROM ({X03})) WHERE b = 1", ("timestamp",))
def x03(spark, d):
    return taskforms.repeat_labels(orders_window(spark, d, F.max((F.col("o_orderstatus") == "O").cast("int"))))


X03_ONE = window_sql("orders", "o_custkey", "o_orderdate", "CAST(count(*) FILTER (WHERE o_orderstatus = 'O') > 0 AS INTEGER)", [LAST], 90)


@query("x03_repeat_single_anchor", f"SELECT * FROM ({X03_ONE}) WHERE key IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '{LAST}' - INTERVAL 180 DAY AND o_orderdate <= TIMESTAMP '{LAST}')", ("timestamp",))
def x03_single(spark, d):
    return taskforms.repeat_label_form(table(spark, d, "orders"), "o_custkey", "o_orderdate", [LAST], 90, F.col("o_orderstatus") == "O")


@query("x04_negated_max", window_sql("orders", "o_custkey", "o_orderdate", "CAST(max(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS INTEGER)", ANCHORS, 90) + " HAVING a.t < (SELECT max(o_orderdate) + INTERVAL 365 DAY FROM orders o2 WHERE o2.o_custkey = orders.o_custkey)", ("timestamp",))
def x04(spark, d):
    found = orders_window(spark, d, F.max(F.when(F.col("o_orderstatus") != "F", 1).otherwise(0)))
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("last"))
    # Active after anchor - 1 year, without an upper bound.
    return found.join(last, "key").where(F.col("last") > F.col("timestamp") - F.expr("INTERVAL 365 DAY")).select("timestamp", "key", "target")


@query("x05_mean", window_sql("orders", "o_custkey", "o_orderdate", "round(avg(o_totalprice), 6)", ANCHORS, 90), ("timestamp",))
def x05(spark, d):
    return orders_window(spark, d, F.avg("o_totalprice"))


@query("x06_minimum_at_most", window_sql("orders", "o_custkey", "o_orderdate", "CAST(min(o_totalprice) <= 50000 AS INTEGER)", ANCHORS, 90), ("timestamp",))
def x06(spark, d):
    return orders_window(spark, d, (F.min("o_totalprice") <= 50000).cast("int"))


def priced_lines(spark, d):
    """Line items with a value held by the linked part."""
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate").join(part, F.col("l_partkey") == F.col("p_partkey"))


@query("x07_joined_value_sum", window_sql("lineitem JOIN part ON l_partkey = p_partkey", "l_suppkey", "l_shipdate", "round(sum(p_retailprice), 4)", ANCHORS, 90).replace("JOIN lineitem JOIN part ON l_partkey = p_partkey ON", "JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey) ON"), ("timestamp",))
def x07(spark, d):
    return rounded(taskforms.window_labels(priced_lines(spark, d), "l_suppkey", "l_shipdate", ANCHORS, 90, F.sum("p_retailprice")))


@query(
    "x08_joined_value_recent",
    f"WITH v AS (SELECT l_suppkey AS k, l_shipdate AS s_at, p_retailprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey), p AS (SELECT DISTINCT a.t, k FROM {anchors_sql(ANCHORS)} a JOIN v ON s_at > a.t - INTERVAL 10 DAY AND s_at <= a.t), s AS (SELECT a.t, k, sum(v) AS s FROM {anchors_sql(ANCHORS)} a JOIN v ON s_at > a.t AND s_at <= a.t + INTERVAL 10 DAY GROUP BY 1, 2) SELECT t AS timestamp, k AS key, round(coalesce(s, 0), 4) AS target FROM p LEFT JOIN s USING (t, k)",
    ("timestamp",),
)
def x08(spark, d):
    lines = priced_lines(spark, d)
    sums = taskforms.window_labels(lines, "l_suppkey", "l_shipdate", ANCHORS, 10, F.sum("p_retailprice"))
    return rounded(taskforms.with_default(taskforms.active_pairs(lines, "l_suppkey", "l_shipdate", ANCHORS, 10), sums, F.lit(0.0)))


@query("x09_ratio_having", window_sql("lineitem", "l_partkey", "l_shipdate", "round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6)", ANCHORS, 90, " HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0"), ("timestamp",))
def x09(spark, d):
    hits = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return rounded(taskforms.window_labels(table(spark, d, "lineitem"), "l_partkey", "l_shipdate", ANCHORS, 90, hits / F.count(F.lit(1)), hits > 0), 6)


@query("x10_two_hop_count", window_sql("(SELECT o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "o_custkey", "l_shipdate", "CAST(count(*) > 2 AS INTEGER)", ANCHORS, 90), ("timestamp",))
def x10(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return taskforms.window_labels(lines, "o_custkey", "l_shipdate", ANCHORS, 90, (F.count(F.lit(1)) > 2).cast("int"))


@query("x11_distinct_above", window_sql("lineitem", "l_suppkey", "l_shipdate", "CAST(count(DISTINCT l_partkey) > 3 AS INTEGER)", ANCHORS, 90), ("timestamp",))
def x11(spark, d):
    counts = taskforms.distinct_counts(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", ANCHORS, 90, "l_partkey")
    return counts.select("timestamp", "key", (F.col("n") > 3).cast("int").alias("target"))


def created_sql(target: str) -> str:
    """Orders created by the anchor, and line items of each in the window."""
    return f"WITH p AS (SELECT a.t, o_orderkey AS k FROM {anchors_sql(ANCHORS)} a JOIN orders ON o_orderdate <= a.t), h AS (SELECT a.t, l_orderkey AS k, count(DISTINCT l_suppkey) AS n FROM {anchors_sql(ANCHORS)} a JOIN lineitem ON l_shipdate > a.t AND l_shipdate <= a.t + INTERVAL 90 DAY GROUP BY 1, 2) SELECT t AS timestamp, k AS key, {target} AS target FROM p LEFT JOIN h USING (t, k)"


def created(spark, d):
    population = taskforms.created_population(table(spark, d, "orders"), "o_orderkey", "o_orderdate", ANCHORS)
    counts = taskforms.distinct_counts(table(spark, d, "lineitem"), "l_orderkey", "l_shipdate", ANCHORS, 90, "l_suppkey").withColumnRenamed("n", "target")
    return taskforms.with_default(population, counts, F.lit(0))


@query("x12_created_distinct_count", created_sql("CAST(coalesce(n, 0) AS BIGINT)"), ("timestamp",))
def x12(spark, d):
    return created(spark, d)


@query("x13_created_exists", created_sql("CAST(coalesce(n, 0) > 0 AS INTEGER)"), ("timestamp",))
def x13(spark, d):
    return created(spark, d).withColumn("target", (F.col("target") > 0).cast("int"))


UNION = "(SELECT o_custkey AS k, o_orderdate AS s_at FROM orders UNION SELECT o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("x14_union_exists", f"WITH u AS {UNION}, p AS (SELECT a.t, k FROM {anchors_sql(ANCHORS)} a JOIN (SELECT k, min(s_at) AS f FROM u GROUP BY 1) ON f <= a.t), h AS (SELECT DISTINCT a.t, k, 1 AS y FROM {anchors_sql(ANCHORS)} a JOIN u ON s_at > a.t AND s_at <= a.t + INTERVAL 90 DAY) SELECT t AS timestamp, k AS key, coalesce(y, 0) AS target FROM p LEFT JOIN h USING (t, k)", ("timestamp",))
def x14(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("l_shipdate").alias("at"))
    every = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).unionByName(lines).distinct()
    hits = taskforms.window_labels(every, "k", "at", ANCHORS, 90, F.lit(1))
    return taskforms.with_default(taskforms.ever_active(every, "k", "at", ANCHORS), hits, F.lit(0))


@query(
    "x15_two_step_bridge",
    f"WITH o AS (SELECT a.t, l_orderkey AS k, min(l_discount) AS m FROM {anchors_sql(ANCHORS)} a JOIN lineitem ON l_shipdate > a.t AND l_shipdate <= a.t + INTERVAL 90 DAY GROUP BY 1, 2) SELECT t AS timestamp, o_custkey AS key, round(sum(CASE WHEN m <= 0.02 THEN 1 ELSE 0 END) / count(*), 6) AS target FROM o JOIN orders ON k = o_orderkey GROUP BY 1, 2",
    ("timestamp",),
)
def x15(spark, d):
    steps = taskforms.window_labels(table(spark, d, "lineitem"), "l_orderkey", "l_shipdate", ANCHORS, 90, F.min("l_discount"))
    bridge = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    good = F.sum(F.when(F.col("target") <= 0.02, 1).otherwise(0))
    return rounded(steps.join(bridge, "key").groupBy("timestamp", F.col("o_custkey").alias("key")).agg((good / F.count(F.lit(1))).alias("target")), 6)


@query("x16_parent_started_before", f"SELECT a.t AS timestamp, l_orderkey AS key, round(sum(CASE WHEN l_returnflag IN ('R', 'A') THEN l_quantity ELSE 0 END), 4) AS target FROM {anchors_sql(ANCHORS)} a JOIN (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_shipdate > a.t AND l_shipdate <= a.t + INTERVAL 90 DAY AND o_orderdate < a.t GROUP BY 1, 2", ("timestamp",))
def x16(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = in_future(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity"), "l_shipdate", ANCHORS, 90).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    chosen = F.sum(F.when(F.col("l_returnflag").isin("R", "A"), F.col("l_quantity")).otherwise(0.0))
    return rounded(taskforms.anchored_before(rows, "o_orderdate").groupBy("timestamp", F.col("l_orderkey").alias("key")).agg(chosen.alias("target")))


@query("x17_null_or_range_filter", window_sql("(SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0)", "l_suppkey", "l_shipdate", "CAST(min(l_discount) <= 0.01 AS INTEGER)", ANCHORS, 90).replace("WHERE l_suppkey IS NOT NULL", "WHERE l_suppkey IS NOT NULL AND (l_returnflag IS NULL OR l_returnflag <> 'N') AND l_tax BETWEEN 0 AND 0.05"), ("timestamp",))
def x17(spark, d):
    supplier = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    lines = table(spark, d, "lineitem").where((F.col("l_returnflag").isNull() | (F.col("l_returnflag") != "N")) & F.col("l_tax").between(0, 0.05)).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return taskforms.window_labels(lines, "l_suppkey", "l_shipdate", ANCHORS, 90, (F.min("l_discount") <= 0.01).cast("int"))


SUPPLIER = LabelSpec("supplier", "s_suppkey", "lineitem", "l_suppkey", "l_shipdate", "not_exists", 7, "recent")
label_query("x18_supplier_churn", SUPPLIER)
label_query("x18_part_churn", SUPPLIER.but(entity="part", entity_key="p_partkey", link="l_partkey", horizon_days=91))
label_query("x18_part_sales", SUPPLIER.but(entity="part", entity_key="p_partkey", link="l_partkey", op="sum", population="all", value="l_extendedprice"))

# ---------------------------------------------------------------- comparing label sets (C)


def labelled(spark, d, spec: LabelSpec, anchors=ANCHORS) -> DataFrame:
    found = labels.compile_labels(spec, {t: table(spark, d, t) for t in (spec.entity, spec.event)}, anchors)
    return found.withColumnRenamed(spec.entity_key, "key")


def both_sql(a: LabelSpec, b: LabelSpec) -> str:
    named = [f"SELECT timestamp, {s.entity_key} AS key, CAST(target AS DOUBLE) AS target FROM ({label_sql(s, ANCHORS)})" for s in (a, b)]
    return f"WITH a AS ({named[0]}), b AS ({named[1]}), j AS (SELECT a.target AS a, b.target AS b, a.key IS NOT NULL AS in_a, b.key IS NOT NULL AS in_b FROM a FULL OUTER JOIN b USING (timestamp, key)) "


RECENT, WINDOWED = CUSTOMER.but(op="count"), CUSTOMER.but(op="count", population="in_window", filter=PRICE)


@query("c01_coverage", both_sql(RECENT, WINDOWED) + "SELECT CAST(count(*) AS BIGINT) AS n_any, CAST(count(*) FILTER (WHERE in_a AND in_b) AS BIGINT) AS n_both, round(count(*) FILTER (WHERE in_a AND in_b) / count(*), 9) AS coverage FROM j")
def c01(spark, d):
    return rounded(agreement.coverage(labelled(spark, d, RECENT), labelled(spark, d, WINDOWED)), 9)


CHURN, QUIET = CUSTOMER, CUSTOMER.but(population="all", filter=PRICE)


@query("c02_binary_agreement", both_sql(CHURN, QUIET) + "SELECT round(count(*) FILTER (WHERE a = b) / count(*) FILTER (WHERE in_a AND in_b) * (count(*) FILTER (WHERE in_a AND in_b) / count(*)), 9) AS agreement FROM j")
def c02(spark, d):
    return rounded(agreement.binary_agreement(labelled(spark, d, CHURN), labelled(spark, d, QUIET)), 9)


@query("c03_rank_agreement", both_sql(RECENT, WINDOWED) + ", s AS (SELECT a, b FROM j WHERE in_a AND in_b), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM s) SELECT round(greatest(corr(ra, rb), 0) * (SELECT count(*) FROM s) / (SELECT count(*) FROM j), 7) AS agreement FROM r")
def c03(spark, d):
    return rounded(agreement.numeric_agreement(labelled(spark, d, RECENT), labelled(spark, d, WINDOWED)), 7)


@query("c04_gold_agreement", both_sql(RECENT, WINDOWED) + "SELECT round(count(*) FILTER (WHERE in_a AND in_b) / count(*), 9) AS coverage, round(count(*) FILTER (WHERE abs(a - b) <= 1e-3 * greatest(1, abs(b))) / count(*) FILTER (WHERE in_a AND in_b), 9) AS label_match, round(count(*) FILTER (WHERE abs(a - b) <= 1e-3 * greatest(1, abs(b))) / count(*), 9) AS agreement, CAST(count(*) FILTER (WHERE in_b) AS BIGINT) AS n_gold, CAST(count(*) FILTER (WHERE in_a) AS BIGINT) AS n_ours FROM j")
def c04(spark, d):
    return rounded(agreement.gold_agreement(labelled(spark, d, WINDOWED), labelled(spark, d, RECENT), False), 9)


def clarify_sql(prob: float, n: int, slot: str, question: str, agreement_sql: str) -> str:
    return f"SELECT CAST({n} AS INTEGER) AS reading, CAST({prob} AS DOUBLE) AS prob, agreement, '{slot}' AS slot, '{question}' AS question FROM ({agreement_sql}) WHERE agreement < 0.85"


SAME = "SELECT round(coalesce(count(*) FILTER (WHERE a = b) / nullif(count(*) FILTER (WHERE in_a AND in_b), 0), 0) * (count(*) FILTER (WHERE in_a AND in_b) / count(*)), 9) AS agreement FROM j"
RANK_ALIKE = ", s AS (SELECT a, b FROM j WHERE in_a AND in_b), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM s) SELECT round(greatest(corr(ra, rb), 0) * (SELECT count(*) FROM s) / (SELECT count(*) FROM j), 7) AS agreement FROM r"


@query("c05_clarify", " UNION ALL ".join(clarify_sql(p, n, "op", "What about these events is asked?", both_sql(CUSTOMER, s) + SAME) for n, p, s in ((1, 0.3, CUSTOMER.but(op="exists")), (2, 0.2, CUSTOMER.but(op="exists", filter=PRICE)))))
def c05(spark, d):
    specs = [(CUSTOMER, 0.5), (CUSTOMER.but(op="exists"), 0.3), (CUSTOMER.but(op="exists", filter=PRICE), 0.2)]
    return rounded(agreement.clarify(specs, [labelled(spark, d, s) for s, _ in specs]), 9)


NUMERIC = [(RECENT, 0.5), (RECENT.but(op="sum", value="o_totalprice"), 0.3), (WINDOWED, 0.25)]


@query("c05_clarify_numbers", clarify_sql(0.25, 2, "filter", "Which of the events count?", both_sql(RECENT, WINDOWED) + RANK_ALIKE))
def c05_numbers(spark, d):
    return rounded(agreement.clarify(NUMERIC, [labelled(spark, d, s) for s, _ in NUMERIC]), 7)


@query("c06_summary", "WITH t AS (SELECT o_orderpriority AS task, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END) AS agreement FROM orders GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n_tasks, round(avg(accuracy), 9) AS accuracy, round(avg(agreement), 9) AS agreement, round(avg(agreement) FILTER (WHERE task LIKE '1%' OR task LIKE '2%'), 9) AS agreement_subset FROM t")
def c06(spark, d):
    tasks = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy"), F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("agreement"))
    subset = F.col("task").rlike("^[12]")
    return rounded(tasks.agg(F.count(F.lit(1)).alias("n_tasks"), F.avg("accuracy").alias("accuracy"), F.avg("agreement").alias("agreement"), F.avg(F.when(subset, F.col("agreement"))).alias("agreement_subset")), 9)


# ---------------------------------------------------------------- profile, keys, links, times (P)

PROFILED = {"customer": ["c_custkey", "c_nationkey", "c_mktsegment", "c_name"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}


def profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows, CAST(count({c}) AS BIGINT) AS n_values, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, round(1 - count({c}) / count(*), 9) AS null_frac, round(coalesce(avg(length(CAST({c} AS VARCHAR))), 0), 9) AS avg_length FROM {name}" for c in columns
    )


@query("p01_profile_orders", profile_sql("orders", PROFILED["orders"]))
def p01(spark, d):
    return rounded(profile.profile(table(spark, d, "orders"), PROFILED["orders"]), 9)


@query("p02_top_values", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank, substr(CAST({c} AS VARCHAR), 1, 40) AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY {c} QUALIFY rank <= 5" for c in PROFILED["orders"]))
def p02(spark, d):
    return profile.top_values(table(spark, d, "orders"), PROFILED["orders"])


@query("p03_text_length", profile_sql("documents", ["text", "lang", "source"]))
def p03(spark, d):
    return rounded(profile.profile(table(spark, d, "documents"), ["text", "lang", "source"]), 9)


STRINGS, NUMBERS = ["c_name", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"]


@query(
    "p04_column_kinds",
    "WITH p AS (" + profile_sql("customer", STRINGS + NUMBERS[:2]) + ") SELECT \"column\", n_distinct, CASE WHEN \"column\" IN ('c_custkey', 'c_nationkey') THEN 'numeric' WHEN n_distinct <= 50 OR n_distinct <= 0.02 * n_values THEN 'categorical' WHEN avg_length > 30 THEN 'text' WHEN n_distinct > 0.9 * n_values AND avg_length >= 16 THEN 'id' ELSE 'categorical' END AS kind FROM p",
)
def p04(spark, d):
    return profile.column_kinds(table(spark, d, "customer"), STRINGS + NUMBERS[:2]).select("column", "n_distinct", "kind")


@query("p05_key_candidates", "WITH p AS (" + profile_sql("orders", PROFILED["orders"]) + ") SELECT \"column\", n_distinct FROM p WHERE n_distinct = n_rows AND n_values = n_rows")
def p05(spark, d):
    return profile.key_candidates(table(spark, d, "orders"), PROFILED["orders"]).select("column", "n_distinct")


@query("p06_link_inclusion", "WITH v AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_partkey IS NOT NULL) SELECT CAST(count(*) AS BIGINT) AS n_distinct, round(avg(CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_partkey = v) THEN 1.0 ELSE 0.0 END), 9) AS share FROM v")
def p06(spark, d):
    return rounded(relations.inclusion(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part"), "p_partkey"), 9)


@query("p07_time_nulls", "SELECT 'o_orderdate' AS \"column\", avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0.0 END) AS null_frac FROM orders")
def p07(spark, d):
    return relations.time_nulls(table(spark, d, "orders"), ["o_orderdate"])


@query("p08_borrowed_time", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, o_orderdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", ("o_orderdate",))
def p08(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    return relations.borrow_time(lines, "l_orderkey", table(spark, d, "orders"), "o_orderkey", "o_orderdate", "orders")


@query("p10_time_range", 'SELECT min(l_shipdate) AS "first", max(l_shipdate) AS "last" FROM lineitem', ("first", "last"))
def p10(spark, d):
    return relations.time_range(table(spark, d, "lineitem"), "l_shipdate")


#: The star tables with conventional names: a letter and _ go, and a key is named after its table.
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KEY_NAMES = {"regionkey": "region_id", "nationkey": "nation_id", "custkey": "customer_id", "suppkey": "supplier_id", "partkey": "part_id", "orderkey": "order_id"}


def plain_name(column: str) -> str:
    short = re.sub("^[a-z]_", "", column)
    return KEY_NAMES.get(short, short)


def star(spark: SparkSession, d: str, names: tuple[str, ...] = STAR) -> dict[str, DataFrame]:
    found = {n: table(spark, d, n) for n in names}
    return {n: df.toDF(*map(plain_name, df.columns)) for n, df in found.items()}


#: What the star tables hold: column, type class, and the table that it points at. Links of a column to several tables: the first.
STAR_COLUMNS = {
    "region": [("r_regionkey", "id"), ("r_name", "string")],
    "nation": [("n_nationkey", "id"), ("n_name", "string"), ("n_regionkey", "id", "region")],
    "customer": [("c_custkey", "id"), ("c_name", "string"), ("c_nationkey", "id", "nation"), ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "id"), ("s_name", "string"), ("s_nationkey", "id", "nation"), ("s_acctbal", "numeric")],
    "part": [("p_partkey", "id"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "orders": [("o_orderkey", "id"), ("o_custkey", "id", "customer"), ("o_orderstatus", "string"), ("o_totalprice", "numeric"), ("o_orderdate", "time"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "id", "orders"), ("l_partkey", "id", "part"), ("l_suppkey", "id", "supplier"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "time")],
}
STAR_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None}
STAR_LINKS = [(t, c[0], c[2]) for t, columns in STAR_COLUMNS.items() for c in columns if len(c) == 3]
#: Event times stand in for the answers of a decision model: an order's date is when it came into being.
STAR_HINTS = {"orders": "orderdate"}


def kind_sql(c: str, of: str) -> str:
    if of != "string":
        return f"'{of}'"
    d, n, chars = f"count(DISTINCT {c})", f"count({c})", f"coalesce(avg(length({c})), 0)"
    return f"CASE WHEN {d} <= 50 OR {d} <= 0.02 * {n} THEN 'categorical' WHEN {chars} > 30 THEN 'text' WHEN {d} > 0.9 * {n} AND {chars} >= 16 THEN 'id' ELSE 'categorical' END"


@query("p01_sketched_kinds", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{plain_name(c)}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows, CAST(count({c}) AS BIGINT) AS n_values, {kind_sql(c, of)} AS kind, count(DISTINCT {c}) = count(*) AS \"unique\" FROM {t}" for t, columns in STAR_COLUMNS.items() for c, of, *_ in columns))
def p01_sketched(spark, d):
    """Every star table as if it were too large to be counted exactly."""
    parts = [profile.column_kinds(df, exact_up_to=0).select(F.lit(name).alias("table"), "column", "n_rows", "n_values", "kind", (F.col("n_distinct") == F.col("n_rows")).alias("unique")) for name, df in star(spark, d).items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def top_sql(name: str, columns: list[str], k: int = 5) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank, substr(CAST({c} AS VARCHAR), 1, 40) AS value, CAST(count(*) AS BIGINT) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= {k}" for c in columns)


SKETCHED = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey"]


@query("p02_sketched_top_values", top_sql("lineitem", SKETCHED))
def p02_sketched(spark, d):
    return profile.sketched_top_values(table(spark, d, "lineitem"), SKETCHED, tracked=4096)


@query(
    "p06_all_inclusions",
    " UNION ALL ".join(f"SELECT '{t}' AS child, '{plain_name(c)}' AS \"column\", '{p}' AS parent, CAST(count(*) AS BIGINT) AS n_distinct, round(avg(CASE WHEN v IN (SELECT {STAR_KEYS[p]} FROM {p}) THEN 1.0 ELSE 0.0 END), 9) AS share FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)" for t, c, p in STAR_LINKS),
)
def p06_all(spark, d):
    tables = star(spark, d)
    keys = {t: k and plain_name(k) for t, k in STAR_KEYS.items()}
    return rounded(relations.inclusions(tables, keys, relations.link_candidates(tables, keys)), 9)


@query("p06_all_links", " UNION ALL ".join(f"SELECT '{t}' AS child, '{plain_name(c)}' AS \"column\", '{p}' AS parent FROM (SELECT avg(CASE WHEN v IN (SELECT {STAR_KEYS[p]} FROM {p}) THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)) WHERE share >= 0.9" for t, c, p in STAR_LINKS))
def p06_links(spark, d):
    """Keys, kinds and links of the whole database, found from the data."""
    db = database.discover(star(spark, d))
    return spark.createDataFrame([(name, c, p) for name, t in db.items() for c, p in t.links.items()], "child string, column string, parent string")


@query("p09_events_of_entities", "SELECT parent AS entity, child AS event, \"column\" AS link FROM (" + ORACLES["p06_all_links"] + ") WHERE child IN ('orders', 'lineitem')")
def p09(spark, d):
    """Which events point at which entity: what can be asked of each, in the whole database."""
    db = database.discover(star(spark, d), STAR_HINTS)
    links, times = [(name, c, p) for name, t in db.items() for c, p in t.links.items()], {name: t.time for name, t in db.items()}
    rows = [(entity, event, link) for entity in database.entity_candidates(db) for event, link in relations.events_of(entity, links, times)]
    return spark.createDataFrame(rows, "entity string, event string, link string")


@query("p07_derived_time", "SELECT l_orderkey AS order_id, l_linenumber AS linenumber, l_quantity AS quantity, o_orderdate AS \"time\" FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", ("time",))
def p07_derived(spark, d):
    """Line items without a date of their own take that of the order they belong to."""
    tables = star(spark, d, ("orders", "lineitem"))
    lines = database.discover({"orders": tables["orders"], "lineitem": tables["lineitem"].drop("shipdate")}, STAR_HINTS)["lineitem"]
    return lines.df.select("order_id", "linenumber", "quantity", F.col(lines.time).alias("time"))


def describe_sql(names: tuple[str, ...], times: dict[str, str]) -> str:
    """One row a column: what the description says of its table and of itself."""
    parts = []
    for t in names:
        key, time = STAR_KEYS[t], times.get(t)
        for i, (c, of, *to) in enumerate(STAR_COLUMNS[t]):
            role = "'key'" if c == key else "'link'" if to else "'event time'" if c == time else kind_sql(c, of)
            shown = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if of == "time" else f"substr(CAST({c} AS VARCHAR), 1, 40)"
            samples = f"(SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (SELECT {shown} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3))" if of != "numeric" else "CAST(NULL AS VARCHAR)"
            text = lambda x: f"'{plain_name(x)}'" if x else "CAST(NULL AS VARCHAR)"
            parent = f"'{to[0]}'" if to else "CAST(NULL AS VARCHAR)"
            parts.append(f"SELECT '{t}' AS \"table\", '{'event' if time else 'item'}' AS table_role, CAST(count(*) AS BIGINT) AS n_rows, {text(key)} AS key, {text(time)} AS \"time\", CAST({i} AS INTEGER) AS position, {text(c)} AS \"column\", {role} AS role, {parent} AS parent, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, round(1 - count({c}) / count(*), 9) AS null_frac, {samples} AS samples FROM {t}")
    return " UNION ALL ".join(parts)


def described(found: DataFrame) -> DataFrame:
    """A row for each column. Samples of numbers are left out, for engines write them differently."""
    rows = found.select("table", F.col("role").alias("table_role"), "n_rows", "key", "time", F.explode("columns").alias("c")).select("table", "table_role", "n_rows", "key", "time", "c.*")
    number = F.col("column").isin([plain_name(c) for columns in STAR_COLUMNS.values() for c, of, *_ in columns if of == "numeric"])
    return rounded(rows.withColumn("samples", F.when(~number, F.array_join("samples", "|"))), 9)


@query("p11_describe", describe_sql(STAR, {"orders": "o_orderdate", "lineitem": "l_shipdate"}))
def p11(spark, d):
    return described(database.description(database.discover(star(spark, d), STAR_HINTS)))


# ---------------------------------------------------------------- sources and sinks (S)


@query("s01_load_folder", "SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def s01(spark, d):
    found = sources.load_folder(spark, d)
    parts = [found[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("customer", "orders", "lineitem")]
    return parts[0].union(parts[1]).union(parts[2])


@query("s03_load_catalog", "SELECT 'hindcast_orders' AS name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_customers, round(sum(o_totalprice), 2) AS total FROM orders")
def s03(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("hindcast_orders")
    name = "hindcast_orders"
    return rounded(sources.load_catalog(spark)[name].agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_customers"), F.sum("o_totalprice").alias("total")), 2)


@query("s04_load_declared", "SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1")
def s04(spark, d):
    return sources.load_declared(spark, {"supplier": {"pkey": "s_suppkey"}}, d)["supplier"].groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which driver and executors share; of the driver's machine where that is unset (tests)."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='hindcast-')}/hindcast-{uuid.uuid4().hex}"


@query("s05_export", "SELECT c_custkey, c_nationkey, c_acctbal, CAST(count(o_orderkey) AS BIGINT) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def s05(spark, d):
    """A database written with its allowed columns, and a question asked of what its manifest says is there."""
    tables = {t: table(spark, d, t) for t in ("customer", "orders")}
    stated = {"customer": {"pkey": "c_custkey", "fkeys": {"c_nationkey": "nation"}}, "orders": {"pkey": "o_orderkey", "time_col": "o_orderdate", "fkeys": {"o_custkey": "customer"}}}
    folder = scratch(spark)
    sources.write_database(tables, folder, stated, {"customer": ["c_acctbal"], "orders": ["o_totalprice"]})
    found = sources.read_manifest(spark, folder)
    again = sources.load_declared(spark, found, folder)
    sums = again["orders"].groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("s"))
    rows = again["customer"].join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rounded(rows.select("c_custkey", "c_nationkey", "c_acctbal", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("s", F.lit(0.0)).alias("total")), 2)


#: A manifest as a file declares it, with links by column.
DECLARED = {
    "customer": {"pkey": "c_custkey", "fkeys": {"c_nationkey": "nation"}}, "nation": {"pkey": "n_nationkey"}, "supplier": {"pkey": "s_suppkey", "path": "supplier.parquet"},
    "orders": {"pkey": "o_orderkey", "time_col": "o_orderdate", "fkeys": {"o_custkey": "customer"}},
}
DECLARED_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{'event' if e.get('time_col') else 'item'}' AS role, CAST(count(*) AS BIGINT) AS n_rows, '{e['pkey']}' AS key, " + (f"'{e['time_col']}'" if e.get("time_col") else "CAST(NULL AS VARCHAR)") + f" AS \"time\", '{', '.join(f'{c} -> {p}' for c, p in e.get('fkeys', {}).items())}' AS links, {t == 'customer'} AS is_entity FROM {t}" for t, e in DECLARED.items()
)


@query("s04_declared_database", DECLARED_SQL)
def s04_declared(spark, d):
    """Keys, times and links come from the manifest and are put to use: which tables hold events, which can be predicted for."""
    db = database.declared(DECLARED, sources.load_declared(spark, DECLARED, d))
    entities = database.entity_candidates(db)
    rows = database.description(db).select("table", "role", "n_rows", "key", "time", F.filter("columns", lambda c: c["parent"].isNotNull()).alias("linked"))
    return rows.select("table", "role", "n_rows", "key", "time", F.array_join(F.transform("linked", lambda c: F.concat(c["column"], F.lit(" -> "), c["parent"])), ", ").alias("links"), F.col("table").isin(entities).alias("is_entity"))


def manifest_query(name: str, spec: LabelSpec) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The query that a task's manifest carries, run as it stands over the manifest's tables and its anchors."""
        for t in (spec.entity, spec.event):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        anchor_table(spark, ANCHORS).createOrReplaceTempView("timestamp_df")
        return rounded(spark.sql(task_manifest(spec, ANCHORS[-2], ANCHORS[-1])["query"]), 6)

    query(name, label_sql(spec, ANCHORS), ("timestamp",))(run)


manifest_query("s07_manifest_churn", CUSTOMER)
manifest_query("s07_manifest_mean", CUSTOMER.but(op="mean", population="in_window", value="o_totalprice", filter=PRICE))
manifest_query("s07_manifest_sum", CUSTOMER.but(op="sum", population="all", value="o_totalprice", filter=Filter("o_orderstatus", "=", "F")))
manifest_query("s07_manifest_above", CUSTOMER.but(op="count", population="in_window", threshold=1.0))

# ---------------------------------------------------------------- leakage audit (U)

RANKED = "WITH r AS (SELECT *, percent_rank() OVER (ORDER BY l_shipdate) AS pr FROM lineitem), b AS (SELECT *, pr >= 0.97 AS nw, pr BETWEEN 0.4 AND 0.8 AS md FROM r) "
AUDITED = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("u02_null_shift", RANKED + ", q AS (SELECT nw, md, CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN NULL ELSE l_discount END AS x FROM b) SELECT 'x' AS \"column\", round(greatest(2 * (avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE nw) - avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE md)), 0), 9) AS null_shift FROM q")
def u02(spark, d):
    lines = table(spark, d, "lineitem").withColumn("x", F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), None).otherwise(F.col("l_discount")))
    return rounded(audit.null_shift(lines, "l_shipdate", ["x"]), 9)


def shift_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", round(0.5 * sum(abs(n / tn - m / tm)), 9) AS distribution_shift FROM (SELECT {c}, count(*) FILTER (WHERE nw) AS n, count(*) FILTER (WHERE md) AS m FROM b GROUP BY 1), (SELECT count(*) FILTER (WHERE nw) AS tn, count(*) FILTER (WHERE md) AS tm FROM b)"


@query("u03_distribution_shift", RANKED + " UNION ALL ".join(map(shift_sql, AUDITED)))
def u03(spark, d):
    return rounded(audit.distribution_shift(table(spark, d, "lineitem"), "l_shipdate", AUDITED), 9)


def churn_by_segment(spark, d):
    return labelled(spark, d, CUSTOMER.but(population="all")).join(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment"), "key")


def power_sql(bin_: str, source: str) -> str:
    """Out-of-fold means per (bin, anchor), shrunk to the bin and to all; areas by counting pairs below."""
    text = "concat_ws('|', CAST(key AS VARCHAR), strftime(timestamp, '%Y-%m-%d %H:%M:%S'))"
    mean = "WITH l AS (SELECT coalesce(CAST(" + bin_ + " AS VARCHAR), 'missing') AS bin, timestamp AS t, CAST(target AS DOUBLE) AS y, CASE WHEN substr(md5(" + text + "), 1, 1) < '8' THEN 0 ELSE 1 END AS fold FROM (" + source + ")), "
    sums = "g AS (SELECT fold, avg(y) AS m FROM l GROUP BY 1), gb AS (SELECT fold, bin, sum(y) AS s, count(*) AS n FROM l GROUP BY ALL), gt AS (SELECT fold, t, sum(y) AS s, count(*) AS n FROM l GROUP BY ALL), gc AS (SELECT fold, bin, t, sum(y) AS s, count(*) AS n FROM l GROUP BY ALL), "
    met = "x AS (SELECT y, round((coalesce(gc.s, 0) + 5 * (coalesce(gb.s, 0) + 5 * m) / (coalesce(gb.n, 0) + 5)) / (coalesce(gc.n, 0) + 5), 9) AS score, round((coalesce(gt.s, 0) + 5 * m) / (coalesce(gt.n, 0) + 5), 9) AS base FROM l LEFT JOIN g ON g.fold = 1 - l.fold LEFT JOIN gb ON gb.fold = 1 - l.fold AND gb.bin = l.bin LEFT JOIN gt ON gt.fold = 1 - l.fold AND gt.t = l.t LEFT JOIN gc ON gc.fold = 1 - l.fold AND gc.bin = l.bin AND gc.t = l.t), "
    area = lambda c: f"SELECT sum(p * (nb + n / 2)) / (sum(p) * sum(n)) AS v FROM (SELECT p, n, sum(n) OVER (ORDER BY {c}) - n AS nb FROM (SELECT {c}, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY 1))"
    return mean + sums + met + f"a AS ({area('score')}), b AS ({area('base')}) SELECT round(greatest(a.v, 1 - a.v), 6) AS auc, round(greatest(b.v, 1 - b.v), 6) AS base FROM a, b"


SEGMENT_SQL = f"SELECT timestamp, c_custkey AS key, target, c_mktsegment FROM ({label_sql(CUSTOMER.but(population='all'), ANCHORS)}) JOIN customer USING (c_custkey)"


@query("u04_label_power", power_sql("c_mktsegment", SEGMENT_SQL))
def u04(spark, d):
    return rounded(audit.label_power(churn_by_segment(spark, d), F.col("c_mktsegment")), 6)


@query("u05_lift_evidence", "SELECT round(least(greatest((auc - base - 0.05) / 0.15, 0), 1), 6) AS evidence FROM (" + power_sql("CAST(least(extract(year FROM seen), 2002) AS INTEGER)", f"SELECT timestamp, c_custkey AS key, target, seen FROM ({label_sql(CUSTOMER.but(population='all'), ANCHORS)}) LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen FROM orders GROUP BY 1) ON o_custkey = c_custkey") + ")")
def u05(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("seen"))
    rows = labelled(spark, d, CUSTOMER.but(population="all")).join(last, "key", "left")
    found = rounded(audit.label_power(rows, F.least(F.year("seen"), F.lit(2002))), 6)
    return rounded(found.select(audit.lift_evidence(F.col("auc"), F.col("base")).alias("evidence")), 6)


EVIDENCE = "SELECT p_partkey, least(avg(l_discount) * 12, 1) AS prior, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE least(avg(l_tax) * 20, 1) END AS evidence FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"


def evidence_rows(spark, d):
    n = F.count(F.lit(1))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.least(F.avg("l_discount") * 12, F.lit(1.0)).alias("prior"), F.when(n % 5 != 0, F.least(F.avg("l_tax") * 20, F.lit(1.0))).alias("evidence"))
    return lines.join(table(spark, d, "part").select("p_partkey"), "p_partkey", "left_semi")


@query("u06_verdict", f"WITH e AS ({EVIDENCE}), s AS (SELECT *, CASE WHEN evidence IS NULL THEN prior ELSE 1 - (1 - prior) * (1 - evidence) END AS score FROM e) SELECT p_partkey, round(prior, 4) AS prior, round(evidence, 4) AS evidence, round(score, 4) AS score, CASE WHEN prior >= 0.75 OR (evidence IS NOT NULL AND (evidence >= 0.9 OR (score >= 0.6 AND least(prior, evidence) >= 0.25))) THEN 'drop' ELSE 'keep' END AS verdict FROM s")
def u06(spark, d):
    return audit.decide(evidence_rows(spark, d)).select("p_partkey", "prior", "evidence", "score", "verdict")


@query("u07_priors", "SELECT p_brand AS \"table\", p_type AS \"column\", CAST(count(*) AS BIGINT) AS n, round(coalesce(any_value(prior), 0), 6) AS prior FROM part LEFT JOIN (SELECT p_brand AS b, p_type AS t, avg(p_size) / 100 AS prior FROM part WHERE p_size > 25 GROUP BY ALL) ON b = p_brand AND t = p_type GROUP BY ALL")
def u07(spark, d):
    part = table(spark, d, "part")
    columns = part.groupBy(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).agg(F.count(F.lit(1)).alias("n"))
    priors = part.where("p_size > 25").groupBy(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).agg((F.avg("p_size") / 100).alias("prior"))
    return rounded(audit.with_priors(columns, priors).select("table", "column", "n", "prior"), 6)


LEAKY_SQL = "(SELECT c_custkey, c_mktsegment, last_event, CASE WHEN last_event >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY THEN 'active' ELSE 'inactive' END AS status, coalesce(n, 0) AS lifetime_count, coalesce(v, 0) AS lifetime_revenue FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_event, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


def column_power_sql(column: str, value: str, spread: bool) -> str:
    """The evidence of an entity's column; spread values fall into quantile bins over the labels' rows."""
    source = f"SELECT timestamp, c_custkey AS key, target, {value} AS x FROM ({label_sql(CUSTOMER.but(population='all'), ANCHORS)}) LEFT JOIN {LEAKY_SQL} USING (c_custkey)"
    if spread:
        shares = ", ".join(str(k / audit.BINS) for k in range(1, audit.BINS))
        source = f"WITH j AS ({source}) SELECT timestamp, key, target, CASE WHEN x IS NOT NULL THEN len(list_filter(list_distinct((SELECT quantile_disc(x, [{shares}]) FROM j)), lambda v: v <= x)) END AS x FROM j"
    return f"SELECT 'customer' AS \"table\", '{column}' AS \"column\", 'entity' AS role, 0.0 AS prior, least(greatest((auc - base - 0.05) / 0.15, 0), 1) AS evidence FROM ({power_sql('x', source)})"


def audit_sql() -> str:
    days = "(epoch(last_event) - epoch(timestamp)) / 86400.0"
    shifts = [f"SELECT 'lineitem', '{c}', 'event', {p}, least(distribution_shift, 1) FROM ({RANKED}{shift_sql(c)})" for c, p in (("l_returnflag", 0.0), ("l_linestatus", 0.5))]
    powers = [column_power_sql(c, v, spread) for c, v, spread in (("c_mktsegment", "c_mktsegment", False), ("last_event", days, True), ("status", "status", False), ("lifetime_count", "lifetime_count", True), ("lifetime_revenue", "lifetime_revenue", True))]
    rows = " UNION ALL ".join([*powers, *shifts, "SELECT 'part', 'p_brand', 'dimension', 0.8, NULL"])
    score = "CASE WHEN evidence IS NULL THEN prior ELSE 1 - (1 - prior) * (1 - evidence) END"
    return f"SELECT \"table\", \"column\", role, CAST(round(prior, 4) AS DOUBLE) AS prior, CAST(round(evidence, 4) AS DOUBLE) AS evidence, CAST(round(score, 4) AS DOUBLE) AS score, CASE WHEN prior >= 0.75 OR coalesce(evidence >= 0.9 OR (score >= 0.6 AND least(prior, evidence) >= 0.25), FALSE) THEN 'drop' ELSE 'keep' END AS verdict FROM (SELECT *, {score} AS score FROM ({rows}))"


@query("u08_audit", audit_sql())
def u08(spark, d):
    priors = spark.createDataFrame([("lineitem", "l_linestatus", 0.5), ("part", "p_brand", 0.8)], "table string, column string, prior double")
    leaky = audit.plant_leaks(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate")
    tables = {
        "customer": audit.AuditTable(leaky, "c_custkey"), "part": audit.AuditTable(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey"),
        "lineitem": audit.AuditTable(lines, None, "l_shipdate", ["l_orderkey"], {"l_returnflag": "categorical", "l_linestatus": "categorical"}),
    }
    return audit.audit_tables(tables, "customer", labelled(spark, d, CUSTOMER.but(population="all")), priors)


@query("u09_allow_list", f"WITH v AS (SELECT p_partkey FROM ({EVIDENCE}) WHERE prior >= 0.75 OR coalesce(evidence >= 0.9 OR (1 - (1 - prior) * (1 - evidence) >= 0.6 AND least(prior, evidence) >= 0.25), FALSE)) SELECT p_brand AS \"table\", string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS columns FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM v) GROUP BY 1")
def u09(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("table"), F.col("p_partkey").cast("string").alias("column"), F.lit("numeric").alias("kind"), "p_partkey")
    verdicts = audit.decide(evidence_rows(spark, d)).join(part.select("p_partkey", "table", "column"), "p_partkey")
    return audit.allow_list(part.drop("p_partkey"), verdicts)


@query("u10_plant_leaks", "WITH s AS (SELECT o_custkey, max(o_orderdate) AS last_event, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT c_custkey, last_event, CASE WHEN last_event >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY THEN 'active' ELSE 'inactive' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS lifetime_count, round(coalesce(v, 0), 4) AS lifetime_revenue FROM customer LEFT JOIN s ON o_custkey = c_custkey", ("last_event",))
def u10(spark, d):
    return rounded(audit.plant_leaks(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice"))


VERDICTS = f"SELECT p_brand AS t, CAST(e.p_partkey AS VARCHAR) AS c, prior >= 0.75 OR coalesce(evidence >= 0.9 OR (1 - (1 - prior) * (1 - evidence) >= 0.6 AND least(prior, evidence) >= 0.25), FALSE) AS dropped, p_size > 40 AS leak, p_size > 30 AS hand FROM ({EVIDENCE}) e JOIN part USING (p_partkey)"


@query("u11_audit_score", f"SELECT round(count(*) FILTER (WHERE dropped AND leak) / count(*) FILTER (WHERE leak), 9) AS recall, round(avg(CASE WHEN dropped = hand THEN 1.0 ELSE 0.0 END), 9) AS agreement, CAST(count(*) FILTER (WHERE dropped AND NOT leak AND NOT hand) AS BIGINT) AS extra_drops FROM ({VERDICTS})")
def u11(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("table"), F.col("p_partkey").cast("string").alias("column"), "p_size")
    verdicts = audit.decide(evidence_rows(spark, d)).join(part.drop("p_size"), "p_partkey")
    found = audit.audit_score(verdicts, part.where("p_size > 40"), part.where("p_size > 30"))
    return rounded(found, 9)


# ---------------------------------------------------------------- ranks, metrics, baselines, features, predictions (H, M)


@query("h01_percent_rank", "SELECT DISTINCT o_totalprice AS value, CAST(count(*) OVER (PARTITION BY o_totalprice) AS BIGINT) AS n, CAST(rank() OVER (ORDER BY o_totalprice) AS BIGINT) AS rank_min, round(percent_rank() OVER (ORDER BY o_totalprice), 9) AS percent_rank FROM orders")
def h01(spark, d):
    return rounded(value_ranks(table(spark, d, "orders"), "o_totalprice").drop("rank_avg"), 9)


SCORED = "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, (l_quantity + l_discount * 100) / 60 AS prediction FROM lineitem"


def scored(spark, d):
    return table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target"), ((F.col("l_quantity") + F.col("l_discount") * 100) / 60).alias("prediction"))


@query("m01_binary_metrics", f"WITH s AS (SELECT target, prediction, least(greatest(prediction, 0), 1) AS p FROM ({SCORED})), g AS (SELECT prediction, sum(target) AS pos, sum(1 - target) AS neg FROM s GROUP BY 1), c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY prediction) - neg AS below FROM g) SELECT CAST((SELECT count(*) FROM s) AS BIGINT) AS n, round((SELECT avg(target) FROM s), 6) AS positive_rate, round((SELECT avg((p - target) * (p - target)) FROM s), 6) AS brier, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c")
def m01(spark, d):
    return rounded(backtest.binary_metrics(scored(spark, d)), 6)


@query("m02_regression_metrics", "WITH s AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2 FROM s")
def m02(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("target"), (F.col("l_quantity") * 1000).alias("prediction"))
    return rounded(backtest.regression_metrics(rows))


TRAIN_SQL, TEST_SQL = label_sql(CUSTOMER, TRAIN), label_sql(CUSTOMER, [LAST])


def train_test(spark, d):
    tables = {t: table(spark, d, t) for t in ("customer", "orders")}
    return labels.compile_labels(CUSTOMER, tables, TRAIN), labels.compile_labels(CUSTOMER, tables, [LAST])


@query("m03_global_baseline", f"SELECT timestamp, c_custkey, target, round((SELECT avg(target) FROM ({TRAIN_SQL})), 9) AS prediction FROM ({TEST_SQL})", ("timestamp",))
def m03(spark, d):
    return rounded(backtest.global_baseline(*train_test(spark, d)), 9)


ENTITY_SQL = f"SELECT x.timestamp, x.c_custkey, x.target, coalesce(m, (SELECT avg(target) FROM ({TRAIN_SQL}))) AS prediction FROM ({TEST_SQL}) x LEFT JOIN (SELECT c_custkey, avg(target) AS m FROM ({TRAIN_SQL}) GROUP BY 1) USING (c_custkey)"


@query("m04_entity_baseline", f"SELECT timestamp, c_custkey, target, round(prediction, 9) AS prediction FROM ({ENTITY_SQL})", ("timestamp",))
def m04(spark, d):
    train, test = train_test(spark, d)
    return rounded(backtest.entity_baseline(train, test, "c_custkey").select("timestamp", "c_custkey", "target", "prediction"), 9)


@query("s06_stored_predictions", f"SELECT timestamp, c_custkey, round(prediction, 9) AS prediction FROM ({ENTITY_SQL})", ("timestamp",))
def s06(spark, d):
    """Predictions of a run, written once under its name; asked for again, they are read and not made."""
    train, test = train_test(spark, d)
    slug, folder = sources.run_slug("customer", CUSTOMER.op, CUSTOMER.horizon_days, "who stops?", CUSTOMER), scratch(spark)
    make = lambda: rounded(backtest.entity_baseline(train, test, "c_custkey").select("timestamp", "c_custkey", "prediction"), 9)
    sources.stored_predictions(spark, folder, slug, make)
    return sources.stored_predictions(spark, folder, slug, lambda: train.limit(0))


@query(
    "m05_point_in_time_features",
    f"SELECT a.t AS timestamp, o_custkey AS key, CAST(count(*) AS BIGINT) AS n_events, round(sum(o_totalprice), 4) AS sum_value, round(avg(o_totalprice), 6) AS mean_value, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value, CAST(count(*) FILTER (WHERE o_orderdate > a.t - INTERVAL 90 DAY) AS BIGINT) AS n_recent, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate > a.t - INTERVAL 90 DAY), 0), 4) AS sum_recent, CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), CAST(a.t AS DATE)) AS INTEGER) AS days_since_last, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_categories FROM {anchors_sql(ANCHORS)} a JOIN orders ON o_orderdate <= a.t WHERE o_custkey IS NOT NULL GROUP BY 1, 2",
    ("timestamp",),
)
def m05(spark, d):
    return rounded(features.point_in_time(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", ANCHORS, 90, "o_orderpriority"), 6)


@query("m06_fit_predict")
def m06(spark, d):
    train, test = train_test(spark, d)
    known = features.point_in_time(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", [*TRAIN, LAST], 90).withColumnRenamed("key", "c_custkey")
    keys = ["timestamp", "c_custkey"]
    return predict.fit_predict(train.join(known, keys), test.join(known, keys), features.NUMERIC, "c_custkey", True)


TAUGHT = f"c_custkey IN (SELECT c_custkey FROM ({TRAIN_SQL}))"


def baseline_predictions(spark, d):
    """Test labels, and the own means of those customers that have one: the others stay without a prediction."""
    train, test = train_test(spark, d)
    return test, backtest.entity_baseline(train, test, "c_custkey").join(train.select("c_custkey").distinct(), "c_custkey", "left_semi")


@query("m07_score", f"WITH t AS ({TEST_SQL}), p AS (SELECT * FROM ({ENTITY_SQL}) WHERE {TAUGHT}) SELECT CAST(count(prediction) AS BIGINT) AS n, round(avg((prediction - t.target) * (prediction - t.target)), 9) AS brier, CAST(count(*) - count(prediction) AS BIGINT) AS n_unpredicted FROM t LEFT JOIN p USING (timestamp, c_custkey)")
def m07(spark, d):
    test, predictions = baseline_predictions(spark, d)
    met = backtest.join_predictions(test, predictions, "c_custkey")
    e = F.col("prediction") - F.col("target")
    return rounded(met.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("brier")).crossJoin(backtest.unpredicted(test, predictions, "c_custkey")), 9)


@query("m08_top_predictions", f"SELECT c_custkey, round(prediction, 9) AS prediction FROM ({ENTITY_SQL}) ORDER BY round(prediction, 9) DESC, c_custkey LIMIT 25")
def m08(spark, d):
    train, test = train_test(spark, d)
    return predict.top_k(rounded(backtest.entity_baseline(train, test, "c_custkey").select("c_custkey", "prediction"), 9), "c_custkey", 25)


#: Anchors a horizon apart up to a horizon before the data's dense end, while a horizon of history lies before them.
LIVE_ANCHORS = "(SELECT CAST(end_day - CAST({0} + {0} * i AS INTEGER) AS TIMESTAMP) AS t FROM x, range(24) r(i) WHERE CAST(end_day - CAST({0} + {0} * i + {0} AS INTEGER) AS TIMESTAMP) >= (SELECT min(o_orderdate) FROM orders))"


def live_sql(spec: LabelSpec) -> str:
    """Smoothed means of the labels at all anchors whose outcome is known, for who is eligible where the data end."""
    taught = label_sql(spec, ANCHORS).replace(anchors_sql(ANCHORS), LIVE_ANCHORS.format(spec.horizon_days))
    who = f"SELECT {spec.entity_key} FROM {spec.entity}"
    if spec.population != "all":
        who = f"SELECT DISTINCT {spec.link} AS {spec.entity_key} FROM {spec.event}, x WHERE {spec.time} > CAST(end_day AS TIMESTAMP) - INTERVAL {spec.past_days} DAY AND {spec.time} <= CAST(end_day AS TIMESTAMP) AND {spec.link} IS NOT NULL"
    return DAILY.rstrip() + SPLIT + f", taught AS ({taught}), own AS (SELECT {spec.entity_key}, CAST(sum(target) AS DOUBLE) AS s, count(*) AS n FROM taught GROUP BY 1), who AS ({who}) SELECT (SELECT CAST(end_day AS TIMESTAMP) FROM x) AS timestamp, {spec.entity_key}, round((coalesce(s, 0) + 5 * (SELECT avg(target) FROM taught)) / (coalesce(n, 0) + 5), 9) AS prediction, CAST(coalesce(n, 0) AS BIGINT) AS n_labels FROM who LEFT JOIN own USING ({spec.entity_key})"


def live_query(name: str, spec: LabelSpec) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: table(spark, sf_dir, t) for t in (spec.entity, spec.event)}
        return rounded(live.predict_live(live.plan_live(spec, tables[spec.event]), tables), 9)

    query(name, live_sql(spec), ("timestamp",))(run)


live_query("m08_live_run", CUSTOMER)
live_query("m08_live_everyone", CUSTOMER.but(op="count", population="all", horizon_days=60))


@query("m08_live_top", f"SELECT CAST(row_number() OVER (ORDER BY prediction DESC, c_custkey) AS INTEGER) AS rank, timestamp, c_custkey, prediction FROM ({live_sql(CUSTOMER)}) QUALIFY rank <= 25", ("timestamp",))
def m08_live_top(spark, d):
    tables = {t: table(spark, d, t) for t in ("customer", "orders")}
    return live.highest(rounded(live.predict_live(live.plan_live(CUSTOMER, tables["orders"]), tables), 9), "c_custkey", 25)


@query("m08_live_linear", times=("timestamp",))
def m08_live_linear(spark, d):
    tables = {t: table(spark, d, t) for t in ("customer", "orders")}
    return live.predict_live_linear(live.plan_live(CUSTOMER, tables["orders"], most=6), tables, "o_totalprice")


@query("m09_lookup", f"SELECT CAST(w.c_custkey AS VARCHAR) AS key, round(prediction, 9) AS prediction FROM customer w LEFT JOIN (SELECT * FROM ({ENTITY_SQL}) WHERE {TAUGHT}) p USING (c_custkey)")
def m09(spark, d):
    _, predictions = baseline_predictions(spark, d)
    return rounded(predict.lookup(predictions, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")), "c_custkey"), 9)


@query("m09_missing", f"SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({TEST_SQL}) WHERE {TAUGHT})")
def m09_missing(spark, d):
    _, predictions = baseline_predictions(spark, d)
    return predict.missing(predictions, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")), "c_custkey")


@query("m10_auc_by_group", "WITH s AS (SELECT l_linestatus, l_quantity AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), g AS (SELECT l_linestatus, p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY l_linestatus ORDER BY p) - neg AS below FROM g) SELECT l_linestatus, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM c GROUP BY 1")
def m10(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(roc_auc(rows, "y", "l_quantity", "l_linestatus"), 6)


# ---------------------------------------------------------------- questions and readings (F)

UNIT_WORDS = ["day", "days", "week", "weeks", "month", "quarters", "years"]
COUNT_WORDS = ["one", "two", "three", "next", "a"]
ASKED = "SELECT o_orderkey, 'Which customers order in the ' || CASE WHEN o_orderkey % 3 = 0 THEN 'next ' || CAST(o_orderkey % 40 + 1 AS VARCHAR) || ' ' || unit WHEN o_orderkey % 3 = 1 THEN word || ' month' ELSE 'end' END AS question FROM (SELECT o_orderkey, list_extract(" + str(UNIT_WORDS) + ", CAST(o_orderkey % 7 + 1 AS INTEGER)) AS unit, list_extract(" + str(COUNT_WORDS) + ", CAST(o_orderkey % 5 + 1 AS INTEGER)) AS word FROM orders)"


def asked(spark, d):
    """Questions about orders, one for each order."""
    k = F.col("o_orderkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    tail = F.when(k % 3 == 0, F.concat(F.lit("next "), (k % 40 + 1).cast("string"), F.lit(" "), pick(UNIT_WORDS))).when(k % 3 == 1, F.concat(pick(COUNT_WORDS), F.lit(" month"))).otherwise("end")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Which customers order in the "), tail).alias("question"))


UNITS_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in questions.UNITS.items()) + "}"
COUNTS_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in questions.COUNTS.items()) + "}"
NUMBERS_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in questions.NUMBERS.items()) + "}"


@query("f01_horizon", f"WITH q AS ({ASKED}), m AS (SELECT *, regexp_extract(lower(question), '([0-9]+) (days?|weeks?|months?|quarters?|years?)', ['n', 'u']) AS a, regexp_extract(lower(question), '(^|[^a-z])(one|two|three|four|six|a|an|next) (day|week|month|quarter|year)s?($|[^a-z])', ['x', 'n', 'u', 'y']) AS b FROM q) SELECT o_orderkey, question, CAST(CASE WHEN a.n <> '' THEN TRY_CAST(a.n AS INTEGER) * {UNITS_SQL}[a.u] WHEN b.n <> '' THEN {COUNTS_SQL}[b.n] * {UNITS_SQL}[b.u] END AS INTEGER) AS days FROM m")
def f01(spark, d):
    return asked(spark, d).withColumn("days", questions.parse_horizon(F.col("question")))


BOUNDS = ["more than", "over", "above", "at least", "exactly"]


@query("f02_threshold", "WITH q AS (SELECT o_orderkey, 'Who places ' || list_extract(" + str(BOUNDS) + ", CAST(o_orderkey % 5 + 1 AS INTEGER)) || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 12 AS VARCHAR) ELSE 'three' END || ' orders?' AS question FROM orders), m AS (SELECT *, regexp_extract(question, '(more than|over|above|at least) ([0-9]+|three)', ['w', 'n']) AS a FROM q) SELECT o_orderkey, CAST(CASE WHEN a.n = '' THEN NULL ELSE CASE WHEN a.n = 'three' THEN 3 ELSE TRY_CAST(a.n AS INTEGER) END - CASE WHEN a.w = 'at least' THEN 1 ELSE 0 END END AS DOUBLE) AS threshold FROM m")
def f02(spark, d):
    k = F.col("o_orderkey")
    bound = F.element_at(F.array(*map(F.lit, BOUNDS)), (k % 5 + 1).cast("int"))
    number = F.when(k % 2 == 0, (k % 12).cast("string")).otherwise("three")
    text = F.concat(F.lit("Who places "), bound, F.lit(" "), number, F.lit(" orders?"))
    return table(spark, d, "orders").select("o_orderkey", questions.parse_threshold(text).alias("threshold"))


@query("f03_lookback", "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 20 + 1) * 7 WHEN 1 THEN o_orderkey % 20 + 1 END AS INTEGER) AS days FROM orders")
def f03(spark, d):
    k = F.col("o_orderkey")
    unit = F.when(k % 3 == 0, F.lit("in the last ")).when(k % 3 == 1, F.lit("over the previous ")).otherwise("in the next ")
    text = F.concat(F.lit("if they bought "), unit, (k % 20 + 1).cast("string"), F.when(k % 3 == 0, F.lit(" weeks")).otherwise(" days"))
    return table(spark, d, "orders").select("o_orderkey", questions.parse_lookback(text).alias("days"))


@query("f04_shortlist", "WITH q AS (SELECT p_partkey AS question_id, list_distinct(regexp_extract_all(lower(replace(p_name || ' ' || p_type, '_', ' ')), '[a-z]+')) AS w FROM part), o AS (SELECT DISTINCT p_type AS label FROM part), n AS (SELECT label, row_number() OVER (ORDER BY label) AS position, list_distinct(regexp_extract_all(lower(label), '[a-z]+')) AS v FROM o), s AS (SELECT question_id, label, CAST(len(list_intersect(w, v)) AS INTEGER) AS shared, position FROM q, n) SELECT question_id, label, shared, CAST(row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, position) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def f04(spark, d):
    part = table(spark, d, "part")
    types = part.select(F.col("p_type").alias("label")).distinct()
    from pyspark.sql import Window

    options = types.withColumn("position", F.row_number().over(Window.orderBy("label"))).withColumn("description", F.lit(""))
    asked_about = part.select(F.col("p_partkey").alias("question_id"), F.concat_ws(" ", "p_name", "p_type").alias("question"))
    return readings.shortlist(asked_about.crossJoin(F.broadcast(options)), 3)


ANSWERS = "SELECT user_id AS question_id, event_type AS label, hour(ts) % 3 AS model, count(*) / sum(count(*)) OVER (PARTITION BY user_id, hour(ts) % 3) AS p FROM events GROUP BY user_id, event_type, hour(ts) % 3"


def answers(spark, d):
    """Shares of event types per user and third of the hours: stand-ins for the probabilities that models give."""
    from pyspark.sql import Window

    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("question_id"), F.col("event_type").alias("label"), (F.hour("ts") % 3).alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("question_id", "label", "model", (F.col("n") / F.sum("n").over(Window.partitionBy("question_id", "model"))).alias("p"))


@query("f05_beam", f"SELECT question_id, model AS slot, label, round(p, 9) AS p, CAST(row_number() OVER (PARTITION BY question_id, model ORDER BY p DESC, label) AS INTEGER) AS rank FROM ({ANSWERS}) QUALIFY (p >= 0.2 AND rank <= 3) OR rank = 1")
def f05(spark, d):
    return rounded(readings.beam(answers(spark, d).withColumnRenamed("model", "slot"), keep=0.2).select("question_id", "slot", "label", "p", "rank"), 9)


F06 = """
WITH c AS (SELECT o_custkey AS question_id, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
ops AS (SELECT question_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'exists' WHEN '2' THEN 'not_exists' WHEN '3' THEN 'count' WHEN '4' THEN 'sum' ELSE 'mean' END AS op, sum(n) / sum(sum(n)) OVER (PARTITION BY question_id) AS p FROM c GROUP BY question_id, o_orderpriority),
pops AS (SELECT question_id, CASE o_orderstatus WHEN 'O' THEN 'all' WHEN 'F' THEN 'recent' ELSE 'in_window' END AS population, sum(n) / sum(sum(n)) OVER (PARTITION BY question_id) AS p FROM c GROUP BY question_id, o_orderstatus),
q AS (SELECT DISTINCT question_id, CASE WHEN question_id % 3 = 0 THEN CAST(question_id % 5 AS DOUBLE) END AS thr, CASE WHEN question_id % 4 = 0 THEN 14 END AS lookback FROM c),
flt AS (SELECT question_id, unnest([NULL, 'price']) AS filter, unnest([0.7, 0.3]) AS p FROM q),
forms AS (
  SELECT question_id, op, CAST(NULL AS DOUBLE) AS threshold, p, lookback FROM ops JOIN q USING (question_id) WHERE NOT (op = 'exists' AND thr IS NOT NULL)
  UNION ALL SELECT question_id, 'count', thr, p * 0.9, lookback FROM ops JOIN q USING (question_id) WHERE op = 'exists' AND thr IS NOT NULL
  UNION ALL SELECT question_id, 'exists', NULL, p * 0.1, lookback FROM ops JOIN q USING (question_id) WHERE op = 'exists' AND thr IS NOT NULL),
r AS (SELECT question_id, op, threshold, filter, population, forms.p AS po, flt.p AS pf, CASE WHEN population = 'recent' AND (op = 'not_exists' OR lookback IS NOT NULL) THEN greatest(pops.p, 0.8) ELSE pops.p END AS pp FROM forms JOIN flt USING (question_id) JOIN pops USING (question_id)),
v AS (SELECT *, sum(pp) OVER (PARTITION BY question_id, op, threshold, filter, po, pf) AS z FROM r WHERE NOT (population = 'in_window' AND (op = 'not_exists' OR (op = 'exists' AND filter IS NULL))) AND NOT (population <> 'in_window' AND op = 'mean')),
b AS (SELECT question_id, op, threshold, filter, population, max(po * pf * pp / z) AS prob FROM v WHERE po * pf * pp / z >= 1e-4 GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(prob, 9) DESC, op, population, coalesce(filter, ''), coalesce(threshold, -1)) AS INTEGER) AS rank FROM b QUALIFY rank <= 5)
SELECT question_id, op, threshold, filter, population, round(prob / sum(prob) OVER (PARTITION BY question_id), 6) AS prob, rank FROM k
"""


@query("f06_rank_readings", F06)
def f06(spark, d):
    from pyspark.sql import Window

    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "question_id")
    total = F.sum("n").over(Window.partitionBy("question_id"))

    def shares(column: str, names: dict[str, str], alias: str) -> DataFrame:
        named = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        counts = orders.groupBy("question_id", named[F.substring(column, 1, 1)].alias(alias)).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("question_id", alias, (F.col("n") / total).alias("p"))

    ops = shares("o_orderpriority", {"1": "exists", "2": "not_exists", "3": "count", "4": "sum", "5": "mean"}, "op")
    pops = shares("o_orderstatus", {"O": "all", "F": "recent", "P": "in_window"}, "population")
    k = F.col("question_id")
    asked_about = orders.select("question_id").distinct()
    thresholds = asked_about.select("question_id", F.when(k % 3 == 0, (k % 5).cast("double")).alias("threshold"), F.when(k % 4 == 0, 14).alias("lookback"))
    options = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("filter"), F.lit(0.7).alias("p")), F.struct(F.lit("price").alias("filter"), F.lit(0.3).alias("p"))))
    filters = asked_about.select("question_id", options.alias("x")).select("question_id", "x.filter", "x.p")
    return rounded(readings.rank_readings(ops, pops, filters, thresholds), 6)


@query("f07_average_answers", f"SELECT question_id, label, round(avg(p), 9) AS p FROM ({ANSWERS}) GROUP BY 1, 2")
def f07(spark, d):
    return rounded(readings.average_answers(answers(spark, d)), 9)


@query(
    "f08_candidate_filters",
    "WITH q AS (SELECT s_suppkey AS question_id, s_suppkey % 400 AS n FROM supplier), v AS (SELECT 'l_returnflag' AS c, l_returnflag AS value FROM lineitem UNION SELECT 'l_linestatus', l_linestatus FROM lineitem) SELECT question_id, c AS \"column\", '=' AS op, value FROM q, v UNION ALL SELECT question_id, 'l_linenumber', op, CAST(n AS VARCHAR) FROM q, (SELECT unnest(['<=', '>=']) AS op) WHERE n NOT IN (7, 14, 30, 60, 90, 180, 365)",
)
def f08(spark, d):
    lines, columns = table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]
    asked_about = table(spark, d, "supplier").select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("rank within "), (F.col("s_suppkey") % 400).cast("string"), F.lit(" places?")).alias("question"))
    return readings.candidate_filters(profile.column_kinds(lines, columns), profile.top_values(lines, columns), asked_about)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
