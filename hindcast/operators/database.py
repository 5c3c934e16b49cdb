"""A database as a whole: tables with what is known of them, found or declared, described, written down and read back.

    db = discover({"customer": ..., "orders": ...})       # profile, keys, links, event times
    db = declared(manifest, tables)                       # the same taken as given
    description(db)                                       # one row a table
    manifest(db)                                          # keys, times and links as a dictionary for JSON

Only metadata reach the driver: one row a column, one a candidate link.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators.profile import EXACT_UP_TO, best_key, column_kinds, sketched_top_values, top_values
from hindcast.operators.relations import borrow_time, events_of, find_links, find_times

#: The greatest share of nulls that an event time may have.
MOST_NULLS = 0.05


@dataclass
class TableMeta:
    """A table and what is known of it. derived: (link column, parent, its time) of a borrowed event time; columns: rows of the profile."""

    df: DataFrame
    key: str | None = None
    time: str | None = None
    links: dict[str, str] = field(default_factory=dict)
    derived: tuple[str, str, str] | None = None
    columns: dict[str, dict[str, Any]] = field(default_factory=dict)

    @property
    def is_event(self) -> bool:
        return self.time is not None

    @property
    def kinds(self) -> dict[str, str]:
        return {c: r["kind"] for c, r in self.columns.items()}


Database = dict[str, TableMeta]


def profiled(df: DataFrame, exact_up_to: int | None = None) -> dict[str, dict[str, Any]]:
    """The profile's row of each column."""
    return {r["column"]: r.asDict() for r in column_kinds(df, None, exact_up_to).collect()}


def discover(tables: Mapping[str, DataFrame], hints: dict[str, str] | None = None, exact_up_to: int | None = None) -> Database:
    """Keys, links and event times from the data; a borrowed event time becomes a column of its table."""
    tables = dict(tables)
    columns = {name: profiled(df, exact_up_to) for name, df in tables.items()}
    kinds = {name: {c: r["kind"] for c, r in found.items()} for name, found in columns.items()}
    keys = {name: best_key({c: r["kind"] for c, r in columns[name].items() if _unique(r)}, df.columns, name, list(tables)) for name, df in tables.items()}
    links = find_links(tables, keys, kinds=kinds)
    usable = {name: [c for c in df.columns if kinds[name].get(c) == "time" and columns[name][c]["n_values"] and columns[name][c]["null_frac"] <= MOST_NULLS] for name, df in tables.items()}
    times = find_times(tables, keys, links, usable, hints)
    db = {name: TableMeta(df, keys[name], None, {c: p for child, c, p in links if child == name}, None, columns[name]) for name, df in tables.items()}
    for name, (time, via) in times.items():
        _set_time(db, name, time, via)
    return db


def _unique(row: dict[str, Any]) -> bool:
    """As profile.UNIQUE says it of rows of a DataFrame."""
    return row["n_distinct"] == row["n_values"] == row["n_rows"] > 0 and row["kind"] in ("id", "numeric", "categorical")


def _set_time(db: Database, name: str, time: str, via: tuple[str, str, str] | None) -> None:
    meta = db[name]
    meta.time, meta.derived = time, via
    if via:
        link, parent, parent_time = via
        meta.df = borrow_time(meta.df, link, db[parent].df, db[parent].key, parent_time, parent)


def declared(manifest: Mapping[str, Mapping[str, Any]], tables: Mapping[str, DataFrame], with_profile: bool = True) -> Database:
    """Keys, times and links taken as given (pkey, time_col, fkeys); columns are still profiled.

    ValueError where the manifest names a table or column that isn't there.
    """
    db: Database = {}
    for name, entry in manifest.items():
        df, links = tables[name], dict(entry.get("fkeys") or {})
        unknown = [c for c in (entry.get("pkey"), entry.get("time_col"), *links) if c and c not in df.columns] + [p for p in links.values() if p not in manifest]
        if unknown:
            raise ValueError(f"{name}: no {', '.join(unknown)}")
        db[name] = TableMeta(df, entry.get("pkey"), entry.get("time_col"), links, None, profiled(df) if with_profile else {})
    return db


def manifest(db: Database) -> dict[str, dict[str, Any]]:
    """What write_database keeps beside the files (fixed names of the file format)."""
    return {name: {"pkey": t.key, "time_col": t.time, "fkeys": dict(t.links)} for name, t in db.items()}


def entity_candidates(db: Database) -> list[str]:
    """Tables with a key at which timed tables point."""
    links = [(name, c, p) for name, t in db.items() for c, p in t.links.items()]
    return [name for name, t in db.items() if t.key and events_of(name, links, {n: x.time for n, x in db.items()})]


def description(db: Database, samples: int = 3, exact_up_to: int | None = None) -> DataFrame:
    """table, role (event or item), n_rows, key, time, via, columns: one row a table.

    columns: in the table's order, with the column's role (key, link, event time, else its kind), the parent it links to, distinct
    values, null share, and its most frequent values.
    """
    parts = None
    for name, t in db.items():
        known = t.columns or profiled(t.df, exact_up_to)
        rows = max((r["n_rows"] for r in known.values()), default=0)
        often = sketched_top_values if rows > (EXACT_UP_TO if exact_up_to is None else exact_up_to) else top_values  # the same values
        shown = [c for c in t.df.columns if c in known]
        role = lambda c: "key" if c == t.key else "link" if c in t.links else "event time" if c == t.time else known[c]["kind"]  # noqa: E731, B023
        facts = t.df.sparkSession.createDataFrame(
            [(i, c, role(c), t.links.get(c), known[c]["n_distinct"], float(known[c]["null_frac"])) for i, c in enumerate(shown)], "position int, column string, role string, parent string, n_distinct long, null_frac double"
        )
        top = often(t.df, shown, samples).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))
        entries = facts.join(F.broadcast(top), "column", "left").select("position", "column", "role", "parent", "n_distinct", "null_frac", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
        text = lambda x: F.lit(x).cast("string")
        one = entries.agg(F.array_sort(F.collect_list(F.struct(*entries.columns))).alias("columns")).select(
            F.lit(name).alias("table"), F.lit("event" if t.is_event else "item").alias("role"), F.lit(rows).cast("long").alias("n_rows"), text(t.key).alias("key"), text(t.time).alias("time"),
            text(t.derived and f"{t.derived[1]}.{t.derived[2]}").alias("via"), "columns",
        )
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError("no table")
    return parts


__all__ = ["Database", "TableMeta", "declared", "description", "discover", "entity_candidates", "manifest", "profiled"]
