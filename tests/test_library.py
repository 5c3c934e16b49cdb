"""The library's operators on small frames with the edge cases, and a sample of registered queries against DuckDB."""

import json
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast import queries as Q
from hindcast.functions import questions
from hindcast.operators import agreement, audit, backtest, features, labels, predict, profile, relations, timeline
from hindcast.operators.ranks import roc_auc, value_ranks
from hindcast.operators.spec import Filter, LabelSpec, anchors_before, baseline_anchors, live_manifest, task_manifest
from hindcast.sources import tables as sources

T = datetime(2023, 3, 1)
SPEC = LabelSpec("sellers", "seller_id", "sales", "seller", "at", "not_exists", 30, "recent")


@pytest.fixture(scope="module")
def market(spark):
    sellers = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "seller_id string")
    rows = [
        ("a", T, 10.0, "x"),  # at the anchor: past, not future
        ("a", T + timedelta(days=30), 20.0, "x"),  # at the window's end: inside
        ("b", T - timedelta(days=30), 5.0, "y"),  # a whole look-back before: outside the past window
        ("b", T + timedelta(days=31), 7.0, "y"),
        ("c", T - timedelta(days=1), None, None),
        ("c", T + timedelta(days=2), None, "x"),
        (None, T + timedelta(days=2), 3.0, "x"),
        ("orphan", T + timedelta(days=3), 4.0, "x"),
    ]
    return {"sellers": sellers, "sales": spark.createDataFrame(rows, "seller string, at timestamp_ntz, price double, kind string")}


def values(df, key="seller_id"):
    return {r[key]: r["target"] for r in df.collect()}


def test_windows_are_half_open(market):
    assert values(labels.compile_labels(SPEC, market, [T])) == {"a": 0, "c": 0}
    assert values(labels.compile_labels(SPEC.but(population="all"), market, [T])) == {"a": 0, "b": 1, "c": 0, "d": 1}
    assert values(labels.compile_labels(SPEC.but(op="exists", population="all"), market, [T])) == {"a": 1, "b": 0, "c": 1, "d": 0}


def test_in_window_keeps_orphans_and_nulls(market):
    inside = SPEC.but(population="in_window", op="count")
    assert values(labels.compile_labels(inside, market, [T])) == {"a": 1, "c": 1, "orphan": 1}
    assert values(labels.compile_labels(inside.but(op="sum", value="price"), market, [T])) == {"a": 20.0, "c": None, "orphan": 4.0}
    assert values(labels.compile_labels(inside.but(op="mean", value="price"), market, [T])) == {"a": 20.0, "orphan": 4.0}
    assert values(labels.compile_labels(inside.but(op="exists", filter=Filter("price", ">=", 10.0)), market, [T])) == {"a": 1, "c": 0, "orphan": 0}


def test_the_filter_is_not_for_the_population(market):
    found = labels.compile_labels(SPEC.but(op="count", filter=Filter("kind", "=", "y")), market, [T])
    assert values(found) == {"a": 0, "c": 0}


def test_lookback_threshold_and_overlap(market):
    assert set(values(labels.compile_labels(SPEC.but(lookback_days=31), market, [T]))) == {"a", "b", "c"}
    assert values(labels.compile_labels(SPEC.but(op="count", threshold=0.0), market, [T])) == {"a": 1, "c": 1}
    found = labels.compile_labels(SPEC.but(op="count", population="in_window"), market, [T, T + timedelta(days=1)]).collect()
    assert len(found) == 7  # b enters only the second window


def test_empty_window_and_empty_events(market, spark):
    late = T + timedelta(days=400)
    assert labels.compile_labels(SPEC, market, [late]).count() == 0
    nothing = {**market, "sales": market["sales"].limit(0)}
    assert set(values(labels.compile_labels(SPEC.but(population="all"), nothing, [T])).values()) == {1}


@pytest.mark.parametrize("change", [{"population": "in_window"}, {"op": "exists", "population": "in_window"}, {"op": "sum"}, {"op": "mean", "value": "price", "population": "all"}, {"op": "median"}, {"population": "some"}])
def test_meaningless_specs(change, market):
    spec = SPEC.but(**change)
    assert not spec.valid()
    with pytest.raises(ValueError):
        labels.compile_labels(spec, market, [T])


def test_live_population(market, spark):
    assert {r[0] for r in labels.live_population(SPEC, market["sellers"], market["sales"], T).collect()} == {"a", "c"}
    assert labels.live_population(SPEC, market["sellers"], market["sales"], T - timedelta(days=900)).count() == 4


def test_anchors_and_manifests():
    assert anchors_before(T, 30, 3) == [T - timedelta(days=60), T - timedelta(days=30), T]
    found = baseline_anchors(T, 30, T - timedelta(days=100))
    assert found == [T - timedelta(days=60), T - timedelta(days=30)]
    task = task_manifest(SPEC, T, T + timedelta(days=30))
    assert task["task_type"] == "binary_classification" and task["timedelta"] == "30 days"
    assert live_manifest(task, T, 30)["test_timestamp"] == "2023-03-01 00:00:00"


def test_splits(spark):
    rows = [(datetime(2022, 1, 1) + timedelta(days=i),) for i in range(200) for _ in range(10)] + [(datetime(2022, 7, 25),)]
    events = spark.createDataFrame(rows, "at timestamp_ntz")
    val, test = timeline.choose_splits(events, "at", 30)
    assert test - val == timedelta(days=30)
    with pytest.raises(ValueError):
        timeline.choose_splits(events, "at", 60)
    with pytest.raises(ValueError):
        timeline.choose_splits(events.limit(0), "at", 5)


QUESTIONS = [
    ("Which sellers will stop selling in the next 30 days?", 30, None, None), ("How much revenue next month?", 30, None, None), ("Who will churn next quarter?", 91, None, None), ("in 2 weeks", 14, None, None),
    ("over the next 3 months", 90, None, None), ("önümüzdeki 30 günde", 30, None, None), ("Which drivers will finish in the top 3?", None, None, None),
    ("Predict whether a user will ignore more than 2 event invitations", None, 2.0, None), ("at least three orders", None, 2.0, None), ("if they have already attended an event in the last 14 days", 14, None, 14), ("in the next 7 days", 7, None, None), (None, None, None, None),
]


def test_questions(spark):
    df = spark.createDataFrame([(q,) for q, *_ in QUESTIONS], "q string")
    got = df.select("q", questions.parse_horizon(F.col("q")), questions.parse_threshold(F.col("q")), questions.parse_lookback(F.col("q"))).collect()
    assert [tuple(r) for r in got] == QUESTIONS


def test_ranks_and_areas(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1), (3.0, 1), (None, 0)], "v double, y int")
    got = {r["value"]: (r["rank_min"], r["rank_avg"], round(r["percent_rank"], 6)) for r in value_ranks(df, "v").collect()}
    assert got == {1.0: (1, 1.5, 0.0), 2.0: (3, 3.0, 0.666667), 3.0: (4, 4.0, 1.0)}
    assert roc_auc(df, "y", "v").first()["auc"] == pytest.approx((0.5 + 1 + 1) / 3)
    assert roc_auc(df.where("y = 1"), "y", "v").first()["auc"] is None


def test_audit_finds_planted_leaks(spark):
    end = datetime(2023, 6, 30)
    sellers = spark.range(120).select(F.concat(F.lit("s"), F.col("id")).alias("k"), F.when(F.col("id") % 3 == 0, "SP").otherwise("RJ").alias("state"), (F.col("id") * 4 + 60).alias("stop"))
    sales = sellers.select("k", F.explode(F.sequence(F.lit(0), F.least("stop", F.lit(540)), F.lit(4))).alias("d")).select("k", F.expr("timestamp_ntz'2022-01-01' + make_dt_interval(CAST(d AS int))").alias("at"), F.lit(1.0).alias("price"))
    leaky = audit.plant_leaks(sellers.drop("stop"), "k", sales, "k", "at", "price")
    spec = LabelSpec("s", "k", "e", "k", "at", "not_exists", 30, "recent")
    train = labels.compile_labels(spec, {"s": sellers, "e": sales}, anchors_before(end - timedelta(days=90), 30, 10)).withColumnRenamed("k", "key")
    none = spark.createDataFrame([], "table string, column string, prior double")
    kinds = {"state": "categorical"}
    found = audit.audit_tables({"s": audit.AuditTable(leaky, "k", kinds=kinds), "e": audit.AuditTable(sales, None, "at", ["k"], {"price": "numeric"})}, "s", train, none)
    got = {r["column"]: (r["role"], r["evidence"], r["verdict"]) for r in found.collect()}
    assert set(got) == {"state", "last_event", "status", "lifetime_count", "lifetime_revenue", "price"}
    assert got["last_event"] == ("entity", 1.0, "drop")
    assert got["state"][1] < 0.25 and got["state"][2] == "keep"
    assert got["price"][0] == "event"
    few = audit.audit_tables({"s": audit.AuditTable(leaky, "k", kinds=kinds)}, "s", train.limit(20), none)
    assert {r["evidence"] for r in few.collect()} == {None}


def test_label_power_of_a_number_without_repeats(spark):
    rows = spark.range(20_000).select(F.expr("timestamp_ntz'2022-01-01'").alias("timestamp"), F.col("id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)).alias("x"))
    rows = rows.withColumn("target", (F.col("x") > 0.5).cast("int"))
    long = audit.binned(rows.select("timestamp", "key", "target"), rows.select("key", "x"), "key", ["x"])
    assert audit.label_powers(long).first()["auc"] > 0.98
    assert audit.audited_columns(rows, "key", "timestamp", [], {"x": "id"}) == ["target"]


def test_verdicts(spark):
    rows = [("t", "a", 0.9, None), ("t", "b", 0.5, None), ("t", "c", 0.0, 0.95), ("t", "d", 0.4, 0.5), ("t", "e", 0.2, 0.8), ("t", "f", 0.05, 0.3)]
    got = {r["column"]: r["verdict"] for r in audit.decide(spark.createDataFrame(rows, "table string, column string, prior double, evidence double")).collect()}
    assert got == {"a": "drop", "b": "keep", "c": "drop", "d": "drop", "e": "keep", "f": "keep"}


def test_verdicts_hang_on_no_last_bit(spark):
    near = lambda x: [np.nextafter(x, 0), x, np.nextafter(x, 1)]
    rows = [(float(p), None) for p in near(0.75)] + [(0.0, float(e)) for e in near(0.9)] + [(float(p), 0.25) for p in near(0.4666666666666667)] + [(float(p), 0.0) for p in near(0.58125)]
    got = [tuple(r) for r in audit.decide(spark.createDataFrame(rows, "prior double, evidence double").coalesce(1)).select("prior", "score", "verdict").collect()]
    assert got == [(0.75, 0.75, "drop")] * 3 + [(0.0, 0.9, "drop")] * 3 + [(0.4667, 0.6, "drop")] * 3 + [(0.5813, 0.5813, "keep")] * 3


ORDERS = 3  # of each part's lines


@pytest.fixture(scope="module")
def reordered(spark, tmp_path_factory):
    """Parts k, 1000 + k, 2000 + k, ... have the same lines, in other orders; the first 20 have a mean discount of 1/16 and no tax, the last 50 low discounts."""
    folder, rng, lines = str(tmp_path_factory.mktemp("reordered")), np.random.default_rng(5), []
    for k in range(200):
        n = 16 if k < 20 else int(rng.choice([16, 24, 28, 32]))
        discount, tax = rng.integers(0, 11 if k < 150 else 3, n), np.zeros(n, int) if k < 20 else rng.integers(0, 9, n)
        while k < 20 and discount.sum() != 100:
            discount = rng.integers(0, 11, n)
        given = pd.DataFrame({"l_partkey": k, "l_discount": discount / 100, "l_tax": tax / 100})
        for i, frame in enumerate((given, given.sort_values(["l_discount", "l_tax"]), given.sort_values(["l_tax", "l_discount"], ascending=False))):
            lines.append(frame.assign(l_partkey=1000 * i + k))
    part = pd.DataFrame([(1000 * i + k, f"Brand#{i}", k % 50 + 1) for i in range(ORDERS) for k in range(200)], columns=["p_partkey", "p_brand", "p_size"])
    for name, frame in (("lineitem", pd.concat(lines)), ("part", part)):
        spark.createDataFrame(frame).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_verdicts_in_any_order_of_rows(spark, reordered):
    found = {r["p_partkey"]: tuple(r)[1:] for r in Q.queries()["u06_verdict"](spark, reordered).collect()}
    assert len(found) == ORDERS * 200 and all(row == found[k % 1000] for k, row in found.items())
    assert {found[k] for k in range(20)} == {(0.75, 0.0, 0.75, "drop")}


def test_allow_lists_in_any_order_of_rows(spark, reordered):
    found = {r["table"]: {int(c) % 1000 for c in r["columns"].split(",")} for r in Q.queries()["u09_allow_list"](spark, reordered).collect()}
    assert len(found) == ORDERS and not any(kept & set(range(20)) for kept in found.values())
    assert all(kept == found["Brand#0"] for kept in found.values())


def test_audit_score_in_any_order_of_rows(spark, reordered, tmp_path):
    part, lines = (Q.table(spark, reordered, t) for t in ("part", "lineitem"))
    scores = set()
    for i in range(ORDERS):
        for name, df, key in (("part", part, "p_partkey"), ("lineitem", lines, "l_partkey")):
            df.where(F.floor(F.col(key) / 1000) == i).write.parquet(str(tmp_path / str(i) / f"{name}.parquet"))
        scores.add(tuple(Q.queries()["u11_audit_score"](spark, str(tmp_path / str(i))).first()))
    assert len(scores) == 1


def test_shift_with_all_rows_at_one_time(spark):
    df = spark.createDataFrame([(T, "x"), (T, None)], "at timestamp_ntz, c string")
    assert audit.age_shift(df, "at", ["c"], ["c"]).first()["evidence"] == 0.0


def test_profile_and_links(spark):
    orders = spark.createDataFrame([(f"o{i}", f"c{i % 3}", None if i == 0 else i % 2 == 0) for i in range(9)], "order_id string, customer_id string, ok boolean")
    customers = spark.createDataFrame([(f"c{i}",) for i in range(3)], "customer_id string")
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(orders).collect()}
    assert kinds == {"order_id": "id", "customer_id": "id", "ok": "bool"}
    assert profile.primary_key(orders, "orders", ["customers"]) == "order_id"
    links = relations.find_links({"orders": orders, "customers": customers}, {"orders": "order_id", "customers": "customer_id"})
    assert links == [("orders", "customer_id", "customers")]
    assert relations.is_creation_time("order_purchase_timestamp") and not relations.is_creation_time("last_login_date")
    borrowed = relations.borrow_time(customers, "customer_id", spark.createDataFrame([("c0", T)], "id string, at timestamp_ntz"), "id", "at", "p")
    assert borrowed.where("at IS NULL").count() == 2


def test_metrics_baselines_features_and_lookup(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "k string, target int")
    test = spark.createDataFrame([("a",), ("z",)], "k string")
    got = {r["k"]: r["prediction"] for r in backtest.entity_baseline(train, test, "k").collect()}
    assert got == {"a": 0.5, "z": pytest.approx(2 / 3)}
    one = spark.createDataFrame([(1.0, 1.0)], "target double, prediction double")
    assert backtest.regression_metrics(one).first()["r2"] is None
    events = spark.createDataFrame([("a", T, 1.0, "x"), ("a", T + timedelta(hours=1), 5.0, "y")], "k string, at timestamp_ntz, v double, c string")
    seen = features.point_in_time(events, "k", "at", "v", [T], 30, "c").first()
    assert (seen["n_events"], seen["sum_value"], seen["n_categories"], seen["days_since_last"]) == (1, 1.0, 1, 0)
    predictions = spark.createDataFrame([(1, 0.81), (2, 0.12)], "id long, prediction double")
    wanted = spark.createDataFrame([("1",), ("9",)], "key string")
    assert {tuple(r) for r in predict.lookup(predictions, wanted, "id").collect()} == {("1", 0.81), ("9", None)}
    assert [r[0] for r in predict.missing(predictions, wanted, "id").collect()] == ["9"]


def test_sources(spark, tmp_path, market):
    assert sources.clean_names(["shop_orders_dataset", "shop_items_dataset", "other"]) == {"shop_orders_dataset": "orders", "shop_items_dataset": "items", "other": "other"}
    assert sources.clean_names(["a_x_table", "a_x_data", "b"])["a_x_table"] == "a_x_table"
    wrote = sources.write_database({"sales": market["sales"]}, str(tmp_path / "db"), {"sales": {"time_col": "at", "fkeys": {"seller": "sellers"}}}, {"sales": ["price"]})
    assert wrote["sales"]["columns"] == ["seller", "at", "price"] and sources.read_manifest(spark, str(tmp_path / "db")) == json.loads(json.dumps(wrote))
    assert sources.load_declared(spark, wrote, str(tmp_path / "db"))["sales"].columns == ["seller", "at", "price"]
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "things.csv").write_text("id,n\n1,2\n3,4\n")
    assert dict(sources.load_folder(spark, str(tmp_path / "csv"))["things"].dtypes) == {"id": "int", "n": "int"}
    slug = sources.run_slug("s", "count", 30, "q", SPEC)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert sources.stored_predictions(spark, str(tmp_path), slug, make).count() == sources.stored_predictions(spark, str(tmp_path), slug, make).count() == 3 and made == [1]


def test_no_nested_loop_over_events(spark):
    tables = {t: Q.table(spark, "/root/testdata/sf0.001", t) for t in ("customer", "orders")}
    for spec in (Q.CUSTOMER, Q.CUSTOMER.but(population="all"), Q.CUSTOMER.but(op="count", population="in_window")):
        plan = labels.compile_labels(spec, tables, Q.ANCHORS)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def rows_of(frame):
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v for v in row))
    return sorted(map(repr, out))


@pytest.mark.parametrize("name", ["l02_not_exists_recent", "l13_lookback", "x14_union_exists", "c03_rank_agreement", "u03_distribution_shift", "u04_label_power", "m01_binary_metrics", "m05_point_in_time_features", "f06_rank_readings", "a03_split"])
def test_registered_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "supplier", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    ours, theirs = Q.queries()[name](spark, folder).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows_of(ours[columns]) == rows_of(theirs[columns])


def test_roc_auc_with_many_distinct_scores(spark):
    rng = np.random.default_rng(3)
    score, label = np.round(rng.random(300_000), 7), (rng.random(300_000) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"y": label, "s": score})).repartition(8)
    rank, pos = pd.Series(score).rank().to_numpy(), int(label.sum())
    want = (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))
    for _ in range(2):
        assert abs(roc_auc(df, "y", "s").first()["auc"] - want) < 1e-12
    assert value_ranks(df, "s").agg(F.max("rank_avg")).first()[0] == rank.max()


def test_clarify(spark):
    spec = LabelSpec("s", "k", "e", "k", "at", "not_exists", 30, "recent")
    mine = spark.createDataFrame([(T, "a", 1), (T, "b", 0)], "timestamp timestamp_ntz, key string, target int")
    flipped, nobody = mine.withColumn("target", 1 - F.col("target")), mine.limit(0)
    readings = [(spec, 0.5), (spec.but(horizon_days=31), 0.4), (spec.but(population="all"), 0.3), (spec.but(horizon_days=90), 0.25), (spec.but(entity="t"), 0.1)]
    got = agreement.clarify(readings, [mine, mine, flipped, nobody, mine]).collect()
    assert [(r["reading"], r["agreement"], r["slot"]) for r in got] == [(2, 0.0, "population"), (3, 0.0, "population")]
    assert agreement.clarify([(spec, 0.5), (spec.but(entity="t"), 0.5)], [mine, mine]).first()["slot"] == "entity"
    assert agreement.clarify(readings[:2], [mine, mine]).count() == 0
    assert agreement.clarify(readings[:1], [mine]).count() == 0
