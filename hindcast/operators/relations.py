"""Links between tables, event times, and times borrowed through a link."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed name patterns of creation times and of times that are not.
CREATED = re.compile(r"(creat|signup|sign_up|join|regist|start|placed|purchase|opened|^date$|^timestamp$)", re.I)
CHANGED = re.compile(r"(last|latest|updated|modified|end)", re.I)
LIKELY = re.compile(r"(purchase|creat|start|order|date$|timestamp$|^date|^time)", re.I)
#: Kinds of columns that can link.
LINKING = ("id", "numeric", "categorical")
UNLIKELY = re.compile(r"(limit|deadline|estimat|due)", re.I)


def may_link(child_column: str, parent: str, parent_key: str) -> bool:
    """Whether the names allow a link: the parent's key at the end of the column's name, or the parent's name before id."""
    child, key = child_column.lower(), parent_key.lower()
    single = parent.lower().removesuffix("s")
    return child == key or len(key) > 3 and child.endswith(key) or child in (f"{single}_id", f"{single}id")


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """n_distinct, share: how many of a column's distinct values stand in the parent's key."""
    values = child.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    known = parent.select(F.col(key).alias("_value"), F.lit(1).alias("_hit")).distinct()
    return values.join(known, "_value", "left").agg(F.count(F.lit(1)).alias("n_distinct"), F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("share"))


def as_key(column: str, kind: T.DataType) -> Column:
    """A value as text, so that whole numbers of any type are equal to each other."""
    value = F.col(column)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = (F.abs(value) < 1e15) & (value == F.floor(value))
        return F.when(whole, value.try_cast("long").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def link_candidates(tables: dict[str, DataFrame], keys: dict[str, str | None], kinds: dict[str, dict[str, str]] | None = None) -> list[tuple[str, str, str]]:
    """(child, column, parent) that names and kinds allow, parents in load order. kinds: of each table's columns; without them, all do."""
    return [
        (name, column, parent)
        for name, df in tables.items()
        for column in df.columns
        if column != keys.get(name) and (kinds is None or kinds.get(name, {}).get(column) in LINKING)
        for parent in tables
        if (key := keys.get(parent)) is not None and parent != name and may_link(column, parent, key)
    ]


def inclusions(tables: dict[str, DataFrame], keys: dict[str, str | None], candidates: list[tuple[str, str, str]]) -> DataFrame:
    """child, column, parent, n_distinct, share of all candidates, from one table of values and the columns that hold them.

    Values are distinct by column before they are shuffled, and met once by value: a value's columns, no more than the candidates
    have, say for which links it counts and for which it is a hit. Null is no value.
    """
    session = next(iter(tables.values())).sparkSession
    if not candidates:
        return session.createDataFrame([], "child string, column string, parent string, n_distinct long, share double")
    held = list(dict.fromkeys([*((t, c) for t, c, _ in candidates), *((p, keys[p]) for _, _, p in candidates)]))
    number = {x: i for i, x in enumerate(held)}
    every = None
    for name, df in tables.items():
        mine = [c for t, c in held if t == name]
        if mine:
            kinds = {f.name: f.dataType for f in df.schema.fields}
            part = df.select(F.explode(F.array(*(F.struct(F.lit(number[name, c]).alias("of"), as_key(c, kinds[c]).alias("value")) for c in mine))).alias("x")).select("x.*")
            every = part if every is None else every.unionByName(part)
    holders = every.where("value IS NOT NULL").distinct().groupBy("value").agg(F.collect_set("of").alias("held"))
    pairs = F.array(*(F.struct(F.lit(i).alias("link"), F.lit(number[t, c]).alias("child"), F.lit(number[p, keys[p]]).alias("parent")) for i, (t, c, p) in enumerate(candidates)))
    met = holders.select("held", F.explode(F.filter(pairs, lambda x: F.array_contains("held", x["child"]))).alias("x"))
    counts = met.groupBy("x.link").agg(F.count(F.lit(1)).alias("n_distinct"), F.avg(F.array_contains("held", F.col("x.parent")).cast("double")).alias("share"))
    named = session.createDataFrame([(i, *x) for i, x in enumerate(candidates)], "link int, child string, column string, parent string")
    return named.join(counts, "link", "left").select("child", "column", "parent", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "share")


def find_links(tables: dict[str, DataFrame], keys: dict[str, str | None], least: float = 0.9, kinds: dict[str, dict[str, str]] | None = None) -> list[tuple[str, str, str]]:
    """(child, column, parent) of every link, by one job for the whole database; of several parents, the first in load order."""
    candidates = link_candidates(tables, keys, kinds)
    good = {(r["child"], r["column"], r["parent"]) for r in inclusions(tables, keys, candidates).where(F.col("share") >= least).collect()}  # a row a candidate
    first: dict[tuple[str, str], str] = {}
    for child, column, parent in candidates:
        if (child, column, parent) in good:
            first.setdefault((child, column), parent)
    return [(child, column, parent) for (child, column), parent in first.items()]


def is_creation_time(column: str) -> bool:
    return bool(CREATED.search(column)) and not CHANGED.search(column)


def pick_time(columns: list[str]) -> str:
    """The likeliest event time by name, else the first."""
    return next((c for c in columns if LIKELY.search(c) and not UNLIKELY.search(c)), columns[0])


def time_nulls(df: DataFrame, times: list[str]) -> DataFrame:
    """column, null_frac of candidate time columns; those above 0.05 can't be event times."""
    rows = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in times))
    return rows.unpivot([], times, "column", "null_frac")


def event_time(df: DataFrame, times: list[str], keyed: bool, hint: str | None = None) -> str | None:
    """The event time of a table with these time columns, or None; hint names it where names alone don't tell."""
    usable = [r["column"] for r in time_nulls(df, times).where("null_frac <= 0.05").collect()] if times else []
    usable = [c for c in times if c in usable]
    if hint in usable:
        return hint
    if not usable:
        return None
    best = pick_time(usable)
    return None if keyed and not is_creation_time(best) else best


def time_options(name: str, own: list[str], links: list[tuple[str, str, str]], times: dict[str, str | None]) -> dict[str, tuple[str, str, str] | None]:
    """What a table without a key can take its event time from: its own columns (None), then parents' event times through a link
    (link column, parent, time), named parent.time."""
    found: dict[str, tuple[str, str, str] | None] = {c: None for c in own}
    for child, column, parent in links:
        if child == name and times.get(parent):
            found.setdefault(f"{parent}.{times[parent]}", (column, parent, times[parent]))
    return found


def find_times(
    tables: dict[str, DataFrame], keys: dict[str, str | None], links: list[tuple[str, str, str]], usable: dict[str, list[str]], hints: dict[str, str] | None = None
) -> dict[str, tuple[str, tuple[str, str, str] | None]]:
    """Event time of each table that has one, with the link it is borrowed through, if it is.

    usable: each table's time columns with few nulls. Tables with a key, and those without timed parents, choose among their own
    columns; a keyed table's time counts only if it marks when rows came into being. Then the tables without a key that point at
    a timed parent choose among their own and the parents' times. hints name a choice (a column, or parent.time) where names alone don't tell.
    """
    hints = hints or {}
    children = {n for n in tables if not keys.get(n) and any(child == n and usable.get(parent) for child, _, parent in links)}
    times: dict[str, str | None] = {}
    for name in tables:
        own = usable.get(name, [])
        if name not in children and own:
            hint = hints.get(name)
            best = hint if hint in own else pick_time(own)
            times[name] = best if hint == best or not keys.get(name) or is_creation_time(best) else None
    found: dict[str, tuple[str, tuple[str, str, str] | None]] = {n: (t, None) for n, t in times.items() if t}
    for name in sorted(children):
        options = time_options(name, usable.get(name, []), links, times)
        if options:
            best = hints[name] if hints.get(name) in options else pick_time(list(options))
            via = options[best]
            found[name] = (best, None) if via is None else (via[2] if via[2] not in tables[name].columns else f"{via[1]}_{via[2]}", via)
    return found


def borrow_time(child: DataFrame, link: str, parent: DataFrame, key: str, time: str, parent_name: str) -> DataFrame:
    """The child's rows with the parent's time; named <parent>_<time> where the child has that name. Rows without a link stay."""
    name = time if time not in child.columns else f"{parent_name}_{time}"
    times = parent.select(F.col(key).alias("_key"), F.col(time).alias(name))
    return child.join(times, child[link] == times["_key"], "left").drop("_key")


def events_of(entity: str, links: list[tuple[str, str, str]], times: dict[str, str | None]) -> list[tuple[str, str]]:
    """(event table, link column) of timed tables that point at the entity."""
    return [(child, column) for child, column, parent in links if parent == entity and times.get(child)]


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))
