"""Does a column leak the future? Shifts of the newest rows, label power, and the verdict over both kinds of evidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators.boosting import boosted_area
from hindcast.operators.profile import EXACT_UP_TO, column_kinds, type_class
from hindcast.operators.ranks import roc_auc, value_ranks

NEWEST, MIDDLE = 0.97, (0.4, 0.8)
#: Quantile bins of numbers and days, and rows below which label power says nothing.
BINS, LEAST_ROWS = 32, 40
#: Rows of an entity table that are looked at, and values of each of its texts among them, to tell whether texts are dates.
SNIFFED_ROWS, SNIFFED = 1000, 20
#: Label rows that boosted trees are fitted to.
BOOSTED_ROWS = 1200
#: Digits after the point that means and their products are taken to before they are compared or rounded further.
STEADY = 12
#: Ways that dates are written as text, besides the ISO forms.
DATE_FORMS = ("yyyy/MM/dd", "dd/MM/yyyy", "dd.MM.yyyy", "dd-MM-yyyy")


def bands(df: DataFrame, time: str) -> DataFrame:
    """Rows in the newest and the middle band by percent rank of time: adds newest, middle. Ties share a rank."""
    ranks = value_ranks(df, time)
    pr = F.col("percent_rank")
    cut = ranks.agg(F.min(F.when(pr >= NEWEST, F.col("value"))).alias("t97"), F.min(F.when(pr >= MIDDLE[0], F.col("value"))).alias("t40"), F.max(F.when(pr <= MIDDLE[1], F.col("value"))).alias("t80"))
    t = F.col(time)
    marked = df.crossJoin(F.broadcast(cut)).withColumn("newest", F.coalesce(t >= F.col("t97"), F.lit(False))).withColumn("middle", F.coalesce((t >= F.col("t40")) & (t <= F.col("t80")), F.lit(False)))
    return marked.drop("t97", "t40", "t80").where("newest OR middle")


def null_shift(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """column, null_shift: twice the growth of the null rate from the middle to the newest rows, at least 0."""
    rows = bands(df.select(time, *columns), time)
    rate = lambda band, c: F.avg(F.when(F.col(band), F.col(c).isNull().cast("double")))
    one = rows.agg(*(F.coalesce(2 * F.greatest(rate("newest", c) - rate("middle", c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "null_shift")


def distribution_shift(df: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """column, distribution_shift: half the sum of differences of value shares between both bands, null being a value."""
    rows = bands(df.select(time, *columns), time).select("newest", "middle", *(F.col(c).cast("string").alias(c) for c in columns))
    long = rows.unpivot(["newest", "middle"], columns, "column", "value")
    counts = long.groupBy("column", "value").agg(F.sum(F.col("newest").cast("int")).alias("new"), F.sum(F.col("middle").cast("int")).alias("mid"))
    totals = counts.groupBy("column").agg(F.sum("new").alias("all_new"), F.sum("mid").alias("all_mid"))
    gap = F.abs(F.try_divide("new", "all_new") - F.try_divide("mid", "all_mid"))
    return counts.join(F.broadcast(totals), "column").groupBy("column").agg(F.coalesce(0.5 * F.sum(gap), F.lit(0.0)).alias("distribution_shift"))


def age_shift(df: DataFrame, time: str, columns: list[str], categorical: list[str]) -> DataFrame:
    """column, evidence: the larger of both shifts, at most 1."""
    nulls = null_shift(df, time, columns)
    shifts = distribution_shift(df, time, categorical) if categorical else df.sparkSession.createDataFrame([], "column string, distribution_shift double")
    return nulls.join(F.broadcast(shifts), "column", "left").select("column", F.least(F.greatest("null_shift", F.coalesce("distribution_shift", F.lit(0.0))), F.lit(1.0)).alias("evidence"))


def _fold(*keys: str) -> Column:
    """0 or 1, from the first hex digit of an MD5 of the row's keys."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return F.when(F.substring(F.md5(text.cast("binary")), 1, 1).isin(*"01234567"), 0).otherwise(1)


def label_powers(long: DataFrame, weight: float = 5.0) -> DataFrame:
    """column, auc, base, n, n_positive of each column: areas of out-of-fold means per (bin, anchor), and per anchor alone.

    long: column, bin, timestamp, key, target (0/1). Means are of the other fold and shrunk: (bin, anchor) to the bin, the bin
    to all. Areas are at least 1/2, null with one class only. Rows are read once, to count the cells (column, fold, bin,
    anchor); all columns' areas come from these counts.
    """
    rows = long.where(F.col("target").isNotNull())
    cell = rows.groupBy("column", F.coalesce(F.col("bin").cast("string"), F.lit("missing")).alias("bin"), F.col("timestamp").alias("t"), _fold("key", "timestamp").alias("fold"))
    cells = cell.agg(F.sum(F.col("target").cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    met = cells.withColumn("other", 1 - F.col("fold")).withColumnsRenamed({"s": "positive", "n": "rows"}).drop("fold")
    for name, on in (("all", []), ("bin", ["bin"]), ("time", ["t"]), ("cell", ["bin", "t"])):
        part = cells.groupBy("column", F.col("fold").alias("other"), *on).agg(F.sum("s").alias(f"s_{name}"), F.sum("n").alias(f"n_{name}"))
        met = met.join(part, ["column", "other", *on], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shrunk = lambda part, to: (zero(f"s_{part}") + weight * to) / (zero(f"n_{part}") + weight)
    # Where the other fold has no row at all, its mean counts as one half.
    mean = F.coalesce(F.try_divide("s_all", "n_all"), F.lit(0.5))
    scores = met.withColumns({"auc": F.round(shrunk("cell", shrunk("bin", mean)), 9), "base": F.round(shrunk("time", mean), 9), "negative": F.col("rows") - F.col("positive")})
    each = scores.unpivot(["column", "positive", "negative"], ["auc", "base"], "side", "score").unpivot(["column", "side", "score"], ["positive", "negative"], "class", "weight")
    area = roc_auc(each.withColumn("y", (F.col("class") == "positive").cast("int")), "y", "score", "column", "side", weight="weight")
    sides = area.groupBy("column").agg(*(F.max(F.when(F.col("side") == c, F.greatest("auc", 1 - F.col("auc")))).alias(c) for c in ("auc", "base")))
    counts = cells.groupBy("column").agg(F.sum("n").cast("long").alias("n"), F.sum("s").cast("long").alias("n_positive"))
    return sides.join(F.broadcast(counts), "column")


def label_power(labels: DataFrame, bin_: Column, weight: float = 5.0) -> DataFrame:
    """One row: auc and base of one way to bin the labels' rows, as label_powers does."""
    long = labels.select(F.lit("").alias("column"), bin_.cast("string").alias("bin"), "timestamp", "key", "target")
    return label_powers(long, weight).select("auc", "base")


def audited_columns(df: DataFrame, key: str | None, time: str | None, links: list[str], kinds: dict[str, str]) -> list[str]:
    """All columns but keys, event times, links and ids. kinds: column to kind, as profile.column_kinds finds them."""
    return [c for c in df.columns if c not in {key, time, *links} and kinds.get(c) != "id"]


def parsed_date(text: Column) -> Column:
    """A date or time written as text, or null. Plain numbers are none: a year or a code is not a date."""
    ways = [text.try_cast("timestamp_ntz"), *(F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz") for form in DATE_FORMS)]
    return F.when(text.rlike("[-/.:]"), F.coalesce(*ways))


def date_texts(entities: DataFrame, columns: list[str]) -> list[str]:
    """Those text columns of which over 90 % of the first SNIFFED values, among SNIFFED_ROWS rows, can be read as dates."""
    texts = [c for c in columns if type_class(entities.schema[c].dataType) == "string"]
    if not texts:
        return []
    first = entities.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(texts))).limit(SNIFFED_ROWS)
    some = first.agg(*(F.slice(F.collect_list(f"_{i}"), 1, SNIFFED).alias(f"_{i}") for i in range(len(texts))))  # collect_list leaves nulls out
    share = some.select(*(F.try_divide(F.size(F.filter(f"_{i}", lambda x: parsed_date(x).isNotNull())), F.size(f"_{i}")).alias(f"_{i}") for i in range(len(texts)))).first()
    return [c for i, c in enumerate(texts) if share[i] is not None and share[i] > 0.9]


def days_from(timestamp: Column, when: Column) -> Column:
    return F.timestamp_diff("SECOND", timestamp.cast("timestamp"), when.cast("timestamp")) / 86400.0


def boosted_powers(labels: DataFrame, entities: DataFrame, key: str, columns: list[str], rows: int = BOOSTED_ROWS) -> DataFrame:
    """The same columns as label_powers, by boosted trees over each column's value and the anchor's time.

    Trees find what bins can't: a value that tells only together with the time. They are fitted to the `rows` label rows of
    smallest hash, on one half and scored on the other; these few rows pick their entities by a broadcast join, and each
    column is a group of its own of that many rows. Texts that are dates are days from the anchor, other texts their order.
    """
    kinds, dates = {f.name: type_class(f.dataType) for f in entities.schema.fields}, set(date_texts(entities, columns))
    few = labels.where(F.col("target").isNotNull()).orderBy(F.xxhash64("key", "timestamp"), "key", "timestamp").limit(rows).select("timestamp", "key", "target", _fold("key", "timestamp").alias("fold"))
    named = entities.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_x{i}") for i, c in enumerate(columns)))
    met = few.join(named.join(F.broadcast(few.select(F.col("key").alias("_key")).distinct()), "_key", "left_semi"), F.col("key") == F.col("_key"), "left")

    def entry(i: int, c: str) -> Column:
        x, nothing = F.col(f"_x{i}"), F.lit(None)
        if kinds[c] == "time" or c in dates:
            number, text = days_from(F.col("timestamp"), x if kinds[c] == "time" else parsed_date(x)), nothing
        else:
            number, text = (x.cast("double"), nothing) if kinds[c] == "numeric" else (nothing, x.cast("string"))
        return F.struct(F.lit(c).alias("column"), number.cast("double").alias("number"), text.cast("string").alias("text"))

    long = met.select(F.unix_timestamp(F.col("timestamp").cast("timestamp")).cast("double").alias("t"), F.col("target").cast("int").alias("y"), "fold", F.explode(F.array(*(entry(i, c) for i, c in enumerate(columns)))).alias("c"))

    def area(frame):
        import pandas as pd

        frame = frame.sort_values(["t", "fold", "y", "number", "text"])  # so that the fit hangs on the rows alone
        x, t, y, fold = frame["number"].to_numpy(float), frame["t"].to_numpy(float), frame["y"].to_numpy(float), frame["fold"].to_numpy()
        if frame["text"].notna().any():
            x = frame["text"].astype("category").cat.codes.to_numpy(float)
            x[x < 0] = float("nan")
        auc, base = (boosted_area(columns, y, fold) for columns in ([x, t], [t]))
        return pd.DataFrame({"column": [frame["column"].iloc[0]], "auc": [auc], "base": [base], "n": [len(y)], "n_positive": [int(y.sum())]})

    return long.select("c.*", "t", "y", "fold").groupBy("column").applyInPandas(area, "column string, auc double, base double, n long, n_positive long")


def binned(labels: DataFrame, entities: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """column, bin, timestamp, key, target: what each column says of each label's row.

    Times, and texts that are dates, become days from the anchor; these and numbers fall into BINS quantile bins (cut at approximate percentiles, one
    row for all columns); other values are bins of their own; a missing value is one too.
    """
    kinds = {f.name: type_class(f.dataType) for f in entities.schema.fields}
    dates = date_texts(entities, columns)
    kinds |= dict.fromkeys(dates, "time")
    named = entities.select(F.col(key).alias("_key"), *((parsed_date(F.col(c)) if c in dates else F.col(c)).alias(f"_x{i}") for i, c in enumerate(columns)))
    met = labels.select("timestamp", "key", "target").join(named, F.col("key") == F.col("_key"), "left")
    value = {f"_x{i}": days_from(F.col("timestamp"), F.col(f"_x{i}")) if kinds[c] == "time" else F.col(f"_x{i}").cast("double" if kinds[c] == "numeric" else "string") for i, c in enumerate(columns)}
    met = met.select("timestamp", "key", "target", *(v.alias(c) for c, v in value.items()))
    spread = [f"_x{i}" for i, c in enumerate(columns) if kinds[c] in ("numeric", "time")]
    if spread:
        shares = F.array(*(F.lit(k / BINS) for k in range(1, BINS)))
        cuts = met.agg(*(F.array_distinct(F.percentile_approx(c, shares, F.lit(100000))).alias(f"{c}_cuts") for c in spread))
        met = met.crossJoin(F.broadcast(cuts))
    place = lambda c: F.when(F.col(c).isNotNull(), F.size(F.filter(f"{c}_cuts", lambda x: x <= F.col(c))))
    bins = {f"_x{i}": (place(f"_x{i}") if f"_x{i}" in spread else F.col(f"_x{i}")).cast("string") for i in range(len(columns))}
    long = met.select("timestamp", "key", "target", *(v.alias(c) for c, v in bins.items())).unpivot(["timestamp", "key", "target"], list(bins), "_x", "bin")
    names = F.create_map(*(F.lit(x) for i, c in enumerate(columns) for x in (f"_x{i}", c)))
    return long.select(names[F.col("_x")].alias("column"), "bin", "timestamp", "key", "target")


def lift_evidence(auc: Column, base: Column) -> Column:
    return F.least(F.greatest((auc - base - 0.05) / 0.15, F.lit(0.0)), F.lit(1.0))


def with_priors(columns: DataFrame, priors: DataFrame) -> DataFrame:
    """columns: table, column, ...; priors: table, column, prior. Columns without a prior have 0."""
    return columns.join(F.broadcast(priors), ["table", "column"], "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))


def decide(evidence: DataFrame) -> DataFrame:
    """evidence: prior, evidence (null where the data can't tell). Adds score and verdict.

    The last bits of a mean of doubles hang on the order in which its rows were met. All three are taken to STEADY digits first, so
    that a limit that is met, or a half that is rounded up, is so in every order and by every number of tasks.
    """
    p, e = F.round("prior", STEADY), F.round("evidence", STEADY)
    score = F.round(F.when(e.isNull(), p).otherwise(1 - (1 - p) * (1 - e)), STEADY)
    drop = F.when(e.isNull(), p >= 0.75).otherwise((p >= 0.75) | (e >= 0.9) | ((score >= 0.6) & (F.least(p, e) >= 0.25)))
    return evidence.withColumns({"score": F.round(score, 4), "verdict": F.when(drop, "drop").otherwise("keep"), "prior": F.round(p, 4), "evidence": F.round(e, 4)})


def allow_list(columns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """table, columns: those that are neither dropped nor text. columns: table, column, kind."""
    dropped = verdicts.where("verdict = 'drop'").select("table", "column")
    kept = columns.where("kind <> 'text'").join(F.broadcast(dropped), ["table", "column"], "left_anti")
    return kept.groupBy("table").agg(F.array_join(F.sort_array(F.collect_set("column")), ",").alias("columns"))


def plant_leaks(entities: DataFrame, key: str, events: DataFrame, link: str, time: str, value: str, active_days: int = 60) -> DataFrame:
    """Test data: entities with their last event, whether it is recent, and lifetime count and revenue."""
    end = events.agg(F.max(time).alias("_end"))
    sums = events.groupBy(F.col(link).alias(key)).agg(F.max(time).alias("last_event"), F.count(F.lit(1)).alias("lifetime_count"), F.sum(value).alias("lifetime_revenue"))
    rows = entities.join(sums, key, "left").crossJoin(F.broadcast(end))
    recent = F.col("last_event") >= F.col("_end") - F.make_dt_interval(F.lit(active_days))
    return rows.select(*entities.columns, "last_event", F.when(recent, "active").otherwise("inactive").alias("status"), F.coalesce("lifetime_count", F.lit(0)).alias("lifetime_count"), F.coalesce("lifetime_revenue", F.lit(0.0)).alias("lifetime_revenue"))


def audit_score(verdicts: DataFrame, planted: DataFrame, by_hand: DataFrame) -> DataFrame:
    """recall of planted leaks, agreement with a hand-made drop list, extra drops. Lists: table, column."""
    mark = lambda df, c: df.select("table", "column").distinct().withColumn(c, F.lit(1))
    rows = verdicts.join(F.broadcast(mark(planted, "leak")), ["table", "column"], "left").join(F.broadcast(mark(by_hand, "hand")), ["table", "column"], "left")
    drop, leak, hand = F.col("verdict") == "drop", F.col("leak").isNotNull(), F.col("hand").isNotNull()
    return rows.agg(F.try_divide(F.sum((drop & leak).cast("int")), F.sum(leak.cast("int"))).alias("recall"), F.avg((drop == hand).cast("double")).alias("agreement"), F.sum((drop & ~leak & ~hand).cast("int")).alias("extra_drops"))


@dataclass
class AuditTable:
    """A table and what is known of it; kinds: column to kind, found by profile.column_kinds where they are left out."""

    df: DataFrame
    key: str | None = None
    time: str | None = None
    links: list[str] = field(default_factory=list)
    kinds: dict[str, str] = field(default_factory=dict)

    def known_kinds(self) -> dict[str, str]:
        return self.kinds or {r["column"]: r["kind"] for r in column_kinds(self.df, exact_up_to=EXACT_UP_TO).select("column", "kind").collect()}  # one row a column


def audit_tables(tables: dict[str, AuditTable], entity: str, labels: DataFrame, priors: DataFrame, mode: str = "both", task_type: str = "binary", method: str = "cells") -> DataFrame:
    """The whole audit: table, column, role, prior, evidence, score, verdict of every audited column.

    The asked entity's columns are judged by their power over the labels (timestamp, key, target), those of other tables with
    an event time by the shift of their newest rows, and those of tables without one, dimensions, by their prior alone. Label
    power says nothing (null) of labels that aren't binary, have one class only, or fewer than 40 rows. mode: both, meaning
    (priors only) or data (evidence only). method: cells counts (bin, anchor) over all label rows, gbt fits boosted trees to some.
    """
    if mode not in ("both", "meaning", "data") or method not in ("cells", "gbt"):
        raise ValueError(f"unknown mode {mode!r} or method {method!r}")
    parts, nothing = [], F.lit(None).cast("double")
    session = labels.sparkSession
    for name, t in tables.items():
        kinds = t.known_kinds()
        columns = audited_columns(t.df, t.key, t.time, t.links, kinds)
        if not columns:
            continue
        role = "entity" if name == entity else "event" if t.time else "dimension"
        every = session.createDataFrame([(c,) for c in columns], "column string")
        if mode == "meaning" or role == "dimension" or (role == "entity" and not t.time and task_type != "binary"):
            found = every.withColumn("evidence", nothing)
        elif t.time:
            found = age_shift(t.df, t.time, columns, [c for c in columns if kinds.get(c) in ("categorical", "bool")])
        else:
            powers = boosted_powers(labels, t.df, t.key, columns) if method == "gbt" else label_powers(binned(labels, t.df, t.key, columns))
            told = (F.col("n") >= LEAST_ROWS) & F.col("auc").isNotNull()
            found = every.join(F.broadcast(powers), "column", "left").select("column", F.when(told, lift_evidence(F.col("auc"), F.col("base"))).alias("evidence"))
        parts.append(found.select(F.lit(name).alias("table"), "column", F.lit(role).alias("role"), "evidence"))
    if not parts:
        parts = [session.createDataFrame([], "table string, column string, role string, evidence double")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return decide(with_priors(rows, priors if mode != "data" else priors.limit(0)))
