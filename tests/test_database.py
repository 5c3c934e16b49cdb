"""Profiles by sketches, keys, links and times of whole databases, live runs, manifests, and the audit's rarer ways."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast import queries as Q
from hindcast.functions import questions
from hindcast.operators import agreement, audit, database, features, labels, live, profile, ranks, relations, taskforms
from hindcast.operators.boosting import area, boosted_area
from hindcast.operators.spec import Filter, LabelSpec, label_query, task_manifest
from hindcast.sources import tables as sources

T = datetime(2023, 1, 30)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return Q.star(spark, SF)


def facts(df):
    return {r["column"]: r.asDict() for r in df.collect()}


# ---------------------------------------------------------------- profiles


def test_sketches_say_what_exact_counts_say(star):
    for name, df in star.items():
        exact, sketched = facts(profile.column_kinds(df)), facts(profile.column_kinds(df, exact_up_to=0))
        assert exact.keys() == sketched.keys()
        for c, r in exact.items():
            s = sketched[c]
            assert (r["n_rows"], r["n_values"], r["kind"], r["null_frac"]) == (s["n_rows"], s["n_values"], s["kind"], s["null_frac"]), (name, c)
            assert abs(r["n_distinct"] - s["n_distinct"]) <= 0.05 * r["n_distinct"] and r["avg_length"] == pytest.approx(s["avg_length"])
        unique = lambda found: {c for c, r in found.items() if r["n_distinct"] == r["n_rows"]}
        assert unique(exact) == unique(sketched)


def test_sketches_add_up_over_parts(spark, star):
    orders = star["orders"]
    halves = [orders.where(F.col("order_id") % 2 == k) for k in (0, 1)]
    merged = facts(profile.estimated(profile.merge_sketches(profile.sketches(halves[0]).unionByName(profile.sketches(halves[1])))))
    assert merged == facts(profile.estimated(profile.sketches(orders)))
    nothing = facts(profile.estimated(profile.sketches(orders.limit(0))))
    assert all(r["n_rows"] == r["n_distinct"] == 0 for r in nothing.values())


def test_sketched_profile_shuffles_no_values(spark):
    """What leaves a task of the sketching pass are sketches: a row a task, whatever the number of rows."""
    df = spark.range(0, 300_000, numPartitions=3).select(F.col("id").alias("a"), (F.col("id") % 100_000).alias("b"))
    plan = profile.sketches(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "hll_sketch_agg" in plan
    got = facts(profile.sketched_profile(df))
    assert got["a"]["n_distinct"] == 300_000  # near-unique, so recounted
    assert got["b"]["n_distinct"] == pytest.approx(100_000, rel=0.05)


def test_distinct_values_of_large_tables_are_counted(spark):
    """Over a million rows, and counts that no decision is near to."""
    n = F.col("id")
    df = spark.range(1_200_000).select((n % 300_007).alias("a"), F.concat(F.lit("x"), n % 200_003).alias("b"), F.when(n % 4 > 0, (n % 90_001) / 100).alias("c"))
    want = {"a": (1_200_000, 300_007), "b": (1_200_000, 200_003), "c": (900_000, 90_001)}
    for found in (profile.profile(df), profile.column_kinds(df)):
        assert {c: (r["n_values"], r["n_distinct"]) for c, r in facts(found).items()} == want


def test_top_values_by_sketch(spark, star):
    lines = star["lineitem"].select("order_id", "linenumber", "returnflag", "shipdate")
    for tracked in (1000, 10_000):
        assert sorted(profile.sketched_top_values(lines, tracked=tracked).collect()) == sorted(profile.top_values(lines).collect())
    rows = spark.createDataFrame([("x",)] * 5 + [("y",)] * 5 + [(None,)] * 20 + [("z" * 50,)], "c string")
    assert [tuple(r) for r in profile.sketched_top_values(rows, k=2).orderBy("rank").collect()] == [("c", 1, "x", 5), ("c", 2, "y", 5)]
    assert profile.sketched_top_values(rows.limit(0)).count() == 0
    skewed = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, 8).when(F.col("id") % 11 == 0, 9).otherwise(F.col("id")).cast("string").alias("c"))
    assert sorted(profile.sketched_top_values(skewed, k=3, tracked=1024).collect()) == sorted(profile.top_values(skewed, k=3).collect())


# ---------------------------------------------------------------- links and times


def test_links_need_names_kinds_and_values(spark):
    parents = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id long, name string")
    child = spark.createDataFrame([(i % 10, 99, None, T, float(i % 10), f"{i % 10}") for i in range(40)], "parent_id long, other_parent_id long, empty_parent_id long, time_parent_id timestamp_ntz, parentid double, x string")
    tables, keys = {"parents": parents, "child": child}, {"parents": "id", "child": None}
    got = {(r["column"], r["n_distinct"], r["share"]) for r in relations.inclusions(tables, keys, [("child", c, "parents") for c in child.columns]).collect()}
    assert got == {("parent_id", 10, 1.0), ("other_parent_id", 1, 0.0), ("empty_parent_id", 0, None), ("time_parent_id", 1, 0.0), ("parentid", 10, 1.0), ("x", 10, 1.0)}
    assert relations.find_links(tables, keys) == [("child", "parent_id", "parents"), ("child", "parentid", "parents")]
    kinds = {"child": {"parent_id": "id", "parentid": "text"}}
    assert relations.find_links(tables, keys, kinds=kinds) == [("child", "parent_id", "parents")]
    assert relations.find_links({"parents": parents}, {"parents": "id"}) == []


def test_first_parent_in_load_order_wins(spark):
    a, b, c = (spark.createDataFrame([(i,) for i in range(n)], "thing_id long") for n in (5, 9, 5))
    for order in ("abc", "bac"):
        tables = {n: {"a": a, "b": b, "c": c}[n] for n in order}
        assert relations.find_links(tables, {"a": "thing_id", "b": "thing_id", "c": None}) == [("c", "thing_id", order[0])]


def test_discover(spark, star):
    db = database.discover(star, Q.STAR_HINTS)
    assert {n: t.key for n, t in db.items()} == {n: k and Q.plain_name(k) for n, k in Q.STAR_KEYS.items()}
    assert {(n, c, p) for n, t in db.items() for c, p in t.links.items()} == {(t, Q.plain_name(c), p) for t, c, p in Q.STAR_LINKS}
    assert {n: t.time for n, t in db.items() if t.time} == {"orders": "orderdate", "lineitem": "shipdate"}
    assert set(database.entity_candidates(db)) == {"customer", "orders", "part", "supplier"}
    # Without a hint an order's date does not say that it is when the order came into being.
    assert database.discover({"orders": star["orders"]})["orders"].time is None


def test_a_keyless_child_chooses_among_own_and_parents_times(spark, star):
    tables = {"orders": star["orders"], "lineitem": star["lineitem"]}
    asked = database.discover(tables, {"orders": "orderdate", "lineitem": "orders.orderdate"})["lineitem"]
    assert asked.time == "orderdate" and asked.derived == ("order_id", "orders", "orderdate")
    assert asked.df.where("orderdate IS NULL").count() == 0 and asked.df.count() == tables["lineitem"].count()
    clash = {"orders": tables["orders"], "lineitem": tables["lineitem"].withColumnRenamed("tax", "orderdate")}
    named = database.discover(clash, {"orders": "orderdate", "lineitem": "orders.orderdate"})["lineitem"]
    assert named.time == "orders_orderdate" and {"orderdate", "orders_orderdate"} <= set(named.df.columns)
    many_nulls = {"orders": tables["orders"], "lineitem": tables["lineitem"].withColumn("shipdate", F.when(F.col("linenumber") > 1, F.col("shipdate")))}
    assert database.discover(many_nulls, Q.STAR_HINTS)["lineitem"].derived == ("order_id", "orders", "orderdate")
    assert relations.time_options("c", ["at"], [("c", "x", "p"), ("c", "y", "q")], {"p": "made", "q": None}) == {"at": None, "p.made": ("x", "p", "made")}


def test_description_of_a_large_table(spark):
    """Over a million rows: distinct values are counted, and samples are the most frequent values."""
    n = F.col("id")
    df = spark.range(1_200_000).select(n.alias("reading_id"), F.when(n % 2 == 0, 7).otherwise(n % 200_003).alias("size"))
    found = database.description(database.discover({"readings": df})).first()
    columns = {c["column"]: c for c in found["columns"]}
    assert (found["n_rows"], found["key"], columns["reading_id"]["n_distinct"]) == (1_200_000, "reading_id", 1_200_000)
    assert columns["size"]["n_distinct"] == df.select("size").distinct().count() and columns["size"]["samples"][0] == "7"


def test_metadata_travel(spark, star, tmp_path):
    """Found, written, read back and taken as declared: the same keys, times, links and description."""
    found = database.discover({t: star[t] for t in ("customer", "orders", "nation")}, Q.STAR_HINTS)
    sources.write_database({n: t.df for n, t in found.items()}, str(tmp_path / "db"), database.manifest(found), {"customer": ["mktsegment"]})
    stated = sources.read_manifest(spark, str(tmp_path / "db"))
    again = database.declared(stated, sources.load_declared(spark, stated, str(tmp_path / "db")))
    assert database.manifest(again) == database.manifest(found) and again["customer"].df.columns == ["customer_id", "nation_id", "mktsegment"]
    rows = {r["table"]: r for r in database.description(again, samples=2).collect()}
    orders = {c["column"]: c for c in rows["orders"]["columns"]}
    assert (rows["orders"]["role"], rows["orders"]["key"], rows["orders"]["time"], rows["customer"]["role"]) == ("event", "order_id", "orderdate", "item")
    assert [c["column"] for c in rows["orders"]["columns"]] == again["orders"].df.columns
    assert orders["order_id"]["role"] == "key" and orders["customer_id"]["parent"] == "customer" and orders["orderdate"]["role"] == "event time" and len(orders["orderstatus"]["samples"]) == 2
    assert database.entity_candidates(again) == ["customer"]
    with pytest.raises(ValueError, match="nobody"):
        database.declared({"customer": {"pkey": "nobody"}}, {"customer": star["customer"]})
    with pytest.raises(ValueError, match="elsewhere"):
        database.declared({"orders": {"fkeys": {"customer_id": "elsewhere"}}}, {"orders": star["orders"]})


# ---------------------------------------------------------------- live runs and features


def test_live_run(spark):
    day = lambda n: T + timedelta(days=n)
    events = spark.createDataFrame([(k, day(-n)) for k, step in (("a", 1), ("b", 25)) for n in range(0, 200, step)] + [(None, day(0)), ("ghost", day(-3)), ("c", day(-100))], "k string, at timestamp_ntz")
    entities = spark.createDataFrame([(k,) for k in ("a", "b", "c", "never")], "k string")
    spec = LabelSpec("s", "k", "e", "k", "at", "exists", 10, "recent")
    run = live.plan_live(spec, events, T)
    assert run.anchors[-1] == day(-10) and run.anchors[0] >= day(-199) + timedelta(days=10) and all(b - a == timedelta(days=10) for a, b in zip(run.anchors, run.anchors[1:]))
    assert run.task["test_timestamp"] == f"{T}" and run.task["task_type"] == "binary_classification"
    tables = {"s": entities, "e": events}
    taught = labels.compile_labels(spec, tables, run.anchors).toPandas()
    assert taught["timestamp"].max() <= pd.Timestamp(day(-10))
    got = {r["k"]: r for r in live.predict_live(run, tables).collect()}
    # The population is who was active in (now - 10 days, now], known to the entity table or not; the rest get no prediction.
    assert set(got) == {"a", "b", "ghost"} and all(r["timestamp"] == T for r in got.values())
    mean, own = taught["target"].mean(), taught[taught["k"] == "a"]["target"]
    assert got["a"]["prediction"] == pytest.approx((own.sum() + 5 * mean) / (len(own) + 5)) and got["ghost"]["prediction"] == pytest.approx(mean) and got["ghost"]["n_labels"] == 0
    top = live.highest(live.predict_live(run, tables), "k", 2).orderBy("rank").collect()
    assert [(r["rank"], r["k"]) for r in top] == [(1, "a"), (2, max(("b", "ghost"), key=lambda k: got[k]["prediction"]))]
    everyone = live.predict_live(live.plan_live(spec.but(population="all"), events, T), tables)
    assert {r["k"] for r in everyone.collect()} == {"a", "b", "c", "never"}
    with pytest.raises(ValueError):
        live.plan_live(spec.but(horizon_days=150), events, T)
    with pytest.raises(ValueError):
        live.plan_live(spec, events.limit(0), T)
    assert live.data_end(events, "at") <= T


def brute_features(rows, anchors, recent):
    out = {}
    for a in anchors:
        for k in {r[0] for r in rows if r[0] is not None}:
            seen = [r for r in rows if r[0] == k and r[1] is not None and r[1] <= a]
            if seen:
                new, v = [r for r in seen if r[1] > a - timedelta(days=recent)], [r[2] for r in seen if r[2] is not None]
                total = sum(v) if v else None
                out[a, k] = (len(seen), total, total / len(v) if v else None, min(v, default=None), max(v, default=None), len(new), sum(r[2] or 0 for r in new), (a.date() - max(r[1] for r in seen).date()).days, len({r[3] for r in seen} - {None}))
    return out


@pytest.mark.parametrize("recent", [1, 7, 10, 200])
def test_features_by_intervals(spark, recent):
    rng = np.random.default_rng(recent)
    rows = [(None if rng.random() < 0.05 else f"k{rng.integers(6)}", None if rng.random() < 0.05 else T + timedelta(hours=int(rng.integers(-2000, 400))), None if rng.random() < 0.1 else float(rng.integers(100)), None if rng.random() < 0.1 else f"c{rng.integers(4)}") for _ in range(400)]
    rows += [("edge", T, 1.0, "c"), ("edge", T - timedelta(days=recent), 2.0, "c"), ("late", T + timedelta(days=400), 1.0, "c"), ("empty", T - timedelta(days=1), None, None)]
    anchors = [T - timedelta(days=20), T - timedelta(days=7), T]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v double, c string").repartition(3)
    got = {(r["timestamp"], r["key"]): tuple(r)[2:] for r in features.point_in_time(df, "k", "at", "v", anchors, recent, "c").collect()}
    want = brute_features(rows, anchors, recent)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k]), k
    assert features.point_in_time(df.limit(0), "k", "at", "v", anchors, recent).count() == 0


def test_features_do_not_repeat_events_for_later_anchors(spark):
    events = spark.range(0, 20_000, numPartitions=2).select((F.col("id") % 10).alias("k"), F.lit(T - timedelta(days=400)).cast("timestamp_ntz").alias("at"), F.lit(1.0).alias("v"))
    df = features.point_in_time(events, "k", "at", "v", [T - timedelta(days=d) for d in range(24)], 30)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Window") < plan.rindex("Exchange")  # rows are repeated above the running sums only
    assert df.count() == 240


# ---------------------------------------------------------------- manifests, forms, questions


@pytest.mark.parametrize(
    "change",
    [{}, {"population": "all"}, {"op": "exists", "lookback_days": 45}, {"op": "exists", "population": "in_window", "filter": Filter("o_orderstatus", "=", "F")}, {"op": "count", "threshold": 1.0}, {"op": "count", "population": "in_window", "filter": Filter("o_orderdate", "<", datetime(2000, 1, 1))},
     {"op": "sum", "value": "o_totalprice", "population": "all"}, {"op": "sum", "value": "o_totalprice", "population": "in_window", "filter": Filter("o_orderpriority", "!=", "it's")}],
)
def test_manifest_query_says_the_label(spark, change):
    spec = Q.CUSTOMER.but(**change)
    tables = {t: Q.table(spark, SF, t) for t in ("customer", "orders")}
    for name, df in {**tables, "timestamp_df": Q.anchor_table(spark, Q.ANCHORS)}.items():
        df.createOrReplaceTempView(name)
    text = task_manifest(spec, T, T)["query"]
    assert text == label_query(spec)
    rows = lambda df: sorted((str(r["timestamp"]), r["c_custkey"], round(float(r["target"]), 6)) for r in df.collect())
    assert rows(spark.sql(text)) == rows(labels.compile_labels(spec, tables, Q.ANCHORS))


def test_repeat_labels_with_one_anchor(spark):
    day = lambda n: T + timedelta(days=n)
    rows = [("twice", day(-15), 1), ("twice", day(3), 1), ("missed", day(-15), 0), ("missed", day(3), 1), ("old", day(-21), 1), ("old", day(3), 1), ("now", day(0), 1), ("now", day(5), 0), (None, day(3), 1), ("quiet", day(-5), 1)]
    events = spark.createDataFrame(rows, "k string, at timestamp_ntz, hit int")
    got = taskforms.repeat_label_form(events, "k", "at", [T], 10, F.col("hit") == 1).collect()
    assert {(r["key"], r["target"]) for r in got} == {("twice", 1), ("now", 0)}
    several = taskforms.repeat_label_form(events, "k", "at", [day(-20), day(-10), T], 10, F.col("hit") == 1).collect()
    assert {(r["timestamp"], r["key"], r["target"]) for r in several} == {(T, "twice", 1), (T, "now", 0)}


def test_question_places(spark):
    cases = [
        ("Who buys more than 2, or at least 9, things?", 2.0, None), ("not over, 2 but over 3", None, None), ("(over ten)", 10.0, None), ("at least many, above five", 5.0, None), ("over 2nd above 7", 7.0, None), ("", None, None), (None, None, None),
        ("active within the past 2 quarters", None, 182), ("in the last days, in the last 3 weeks", None, 21), ("the last 3 weeks", None, None), ("over the previous 1 year", None, 365),
    ]
    df = spark.createDataFrame([(q,) for q, *_ in cases], "q string")
    got = [tuple(r) for r in df.select("q", questions.parse_threshold(F.col("q")), questions.parse_lookback(F.col("q"))).collect()]
    assert got[:1] + got[2:] == cases[:1] + cases[2:]
    assert got[1][1] == 3.0


# ---------------------------------------------------------------- ranks, agreement, audit


@pytest.mark.parametrize("held", [1, 7, 500, 20_000])
def test_ranges_follow_the_data(spark, monkeypatch, held):
    monkeypatch.setattr(ranks, "HELD", held)
    rng = np.random.default_rng(held)
    values = np.round(rng.gamma(0.3, 10, 6000), 3)
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    got = ranks.value_ranks(df, "v").toPandas().sort_values("value")
    want = pd.Series(values).rank().groupby(values).first()
    assert got["value"].tolist() == want.index.tolist() and got["rank_avg"].tolist() == want.tolist()
    counts = df.groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.crossJoin(F.broadcast(ranks._bounds(counts, "value", ("n",)))).groupBy(ranks._range("value").alias("r")).count().toPandas()["count"]
    assert sizes.max() <= max(3 * held, 4) and len(sizes) <= ranks.RANGES
    strings = df.select(F.concat(F.lit("s"), F.col("v").cast("string")).alias("v"))
    assert ranks.value_ranks(strings, "v").agg(F.max("rank_avg")).first()[0] == max(pd.Series("s" + pd.Series(values).astype(str)).rank())
    assert ranks.value_ranks(df.limit(0), "v").count() == 0


def test_ranks_read_their_rows_once(spark):
    df = Q.table(spark, SF, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    found = ranks.roc_auc(df, "y", "l_extendedprice")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 2


@pytest.mark.parametrize("seed", range(3))
def test_rank_agreement_by_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    a = pd.DataFrame({"timestamp": T, "key": [f"k{i}" for i in range(500)], "target": np.maximum(0, rng.integers(-6, 5, 500)).astype(float)})
    b = a.sample(400, random_state=seed).assign(target=lambda d: np.maximum(0, d.target + rng.integers(-1, 2, 400)))
    both = a.merge(b, on="key")
    want = max(both.target_x.rank().corr(both.target_y.rank()), 0) * 400 / 500
    frames = [spark.createDataFrame(x).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")) for x in (a, b)]
    assert agreement.numeric_agreement(*frames).first()[0] == pytest.approx(want)
    nothing = frames[0].limit(0)
    assert agreement.numeric_agreement(nothing, nothing).first()[0] == 1.0 and agreement.numeric_agreement(frames[0], nothing).first()[0] == 0.0
    flat = frames[0].withColumn("target", F.lit(2.0))
    assert agreement.numeric_agreement(flat, flat).first()[0] == 1.0 and agreement.numeric_agreement(flat, flat.withColumn("target", F.lit(3.0))).first()[0] == 0.0


@pytest.fixture(scope="module")
def leaky(spark):
    rng = np.random.default_rng(1)
    n, anchors = 500, [T - timedelta(days=30 * i) for i in range(4)]
    stop = rng.integers(-150, 60, n)
    frame = pd.DataFrame({
        "k": [f"e{i}" for i in range(n)], "last_text": [(T + timedelta(days=int(s))).strftime("%d/%m/%Y") if i % 20 else None for i, s in enumerate(stop)], "last_iso": [(T + timedelta(days=int(s))).isoformat(" ") for s in stop], "last_time": [T + timedelta(days=int(s)) for s in stop],
        "status": np.where(stop > 0, "on", "off"), "town": rng.choice(["x", "y", "z"], n), "size": rng.random(n), "year": rng.integers(1990, 2020, n).astype(str),
    })
    entities = spark.createDataFrame(frame).withColumn("last_time", F.col("last_time").cast("timestamp_ntz"))
    rows = [(a, f"e{i}", int(a + timedelta(days=10) < T + timedelta(days=int(s)))) for a in anchors for i, s in enumerate(stop)]
    return entities, spark.createDataFrame(rows, "timestamp timestamp_ntz, key string, target int")


@pytest.mark.parametrize("method", ["cells", "gbt"])
def test_planted_leaks_are_found_by_both_methods(spark, leaky, method):
    entities, taught = leaky
    assert audit.date_texts(entities, entities.columns) == ["last_text", "last_iso"]
    none = spark.createDataFrame([], "table string, column string, prior double")
    found = audit.audit_tables({"s": audit.AuditTable(entities, "k")}, "s", taught, none, method=method).collect()
    got = {r["column"]: (r["evidence"], r["verdict"]) for r in found}
    assert set(got) == {"last_text", "last_iso", "last_time", "status", "town", "size", "year"}
    for c in ("last_text", "last_iso", "last_time"):
        assert got[c] == (1.0, "drop"), c
    assert got["status"][0] > 0.25
    for c in ("town", "size", "year"):
        assert got[c][0] < 0.25 and got[c][1] == "keep", c


def test_boosted_powers_of_odd_labels(spark, leaky):
    entities, taught = leaky
    one_class = audit.boosted_powers(taught.withColumn("target", F.lit(1)), entities, "k", ["town"]).first()
    assert one_class["auc"] is None and one_class["n_positive"] == one_class["n"]
    strangers = taught.withColumn("key", F.concat(F.lit("?"), "key"))
    assert audit.boosted_powers(strangers, entities, "k", ["town", "size"]).where("auc - base > 0.05").count() == 0
    with pytest.raises(ValueError):
        audit.audit_tables({}, "s", taught, taught, method="guess")


def test_boosting_alone():
    rng = np.random.default_rng(0)
    x, t, fold = rng.random(1000), rng.integers(0, 4, 1000).astype(float), rng.integers(0, 2, 1000)
    y = ((x > 0.5) ^ (t > 1)).astype(int)  # neither number tells anything alone
    assert boosted_area([x, t], y, fold) > 0.95 and boosted_area([t], y, fold) < 0.6
    x[::3] = np.nan
    assert boosted_area([x, t], y, fold) > 0.7
    assert area(np.array([1.0, 1.0, 2.0, 3.0]), np.array([0, 1, 1, 1])) == pytest.approx((0.5 + 1 + 1) / 3)
    assert boosted_area([x], np.zeros(1000, int), fold) is None and boosted_area([x], y, np.zeros(1000, int)) is None


@pytest.mark.parametrize("name", ["m08_live_run", "m08_live_everyone", "p01_sketched_kinds", "p02_sketched_top_values", "p06_all_inclusions", "p07_derived_time", "p11_describe", "s04_declared_database", "s05_export", "s06_stored_predictions", "p09_events_of_entities", "s07_manifest_above", "x03_repeat_single_anchor"])
def test_new_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in Q.STAR:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = Q.queries()[name](spark, SF).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    clean = lambda d: sorted(repr(tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r)) for r in d[columns].itertuples(index=False, name=None))
    assert clean(ours) == clean(theirs)
