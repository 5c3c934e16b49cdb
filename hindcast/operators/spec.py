"""What is asked of the future: a typed, frozen description and the rules for a meaningful one."""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations and populations of the question grammar (fixed values).
OPS = ("not_exists", "exists", "count", "sum", "mean")
POPULATIONS = ("all", "recent", "in_window")
_COMPARE = {"=": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


@dataclass(frozen=True)
class Filter:
    """A comparison of one column with a literal; null matches nothing."""

    column: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in _COMPARE:
            raise ValueError(f"unknown comparison {self.op!r}")

    def on(self, prefix: str = "") -> Column:
        return _COMPARE[self.op](F.col(prefix + self.column), F.lit(self.value))


@dataclass(frozen=True)
class LabelSpec:
    """For entities of a population: what their linked events do in (anchor, anchor + horizon]."""

    entity: str
    entity_key: str
    event: str
    link: str
    time: str
    op: str
    horizon_days: int
    population: str
    value: str | None = None
    filter: Filter | None = None
    threshold: float | None = None
    lookback_days: int | None = None

    @property
    def task_type(self) -> str:
        return "binary" if self.op in ("exists", "not_exists") or self.threshold is not None else "regression"

    @property
    def past_days(self) -> int:
        return self.lookback_days or self.horizon_days

    def problem(self) -> str | None:
        """Why the description can't be meant, or None."""
        if self.op not in OPS:
            return f"unknown op {self.op!r}"
        if self.population not in POPULATIONS:
            return f"unknown population {self.population!r}"
        if self.op in ("sum", "mean") and not self.value:
            return f"{self.op} needs a value column"
        if self.op == "mean" and self.population != "in_window":
            return "a mean is only defined for entities with events in the window"
        if self.population == "in_window" and (self.op == "not_exists" or self.op == "exists" and self.filter is None):
            return "the label would be constant for entities with events in the window"
        return None

    def valid(self) -> bool:
        return self.problem() is None

    def checked(self) -> LabelSpec:
        if why := self.problem():
            raise ValueError(why)
        return self

    def but(self, **changes: Any) -> LabelSpec:
        return replace(self, **changes)


def anchors_before(last: datetime, horizon_days: int, n: int) -> list[datetime]:
    """n anchors a horizon apart, ascending, the last included."""
    return [last - timedelta(days=horizon_days) * i for i in reversed(range(n))]


def baseline_anchors(val: datetime, horizon_days: int, first_event: datetime, most: int = 60) -> list[datetime]:
    """From a horizon before val backwards, while a whole horizon of history lies before; at most so many, ascending."""
    step, at, found = timedelta(days=horizon_days), val - timedelta(days=horizon_days), []
    while at - step >= first_event and len(found) < most:
        found.append(at)
        at -= step
    return found[::-1]


def _literal(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value:%Y-%m-%d %H:%M:%S}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def label_query(spec: LabelSpec) -> str:
    """The labels as Spark SQL over the spec's tables and timestamp_df(timestamp), the anchors. compile_labels gives the same rows
    without a join on an inequality; this text is what a manifest carries to whoever else must compute them."""
    name = lambda x: f"`{x}`"
    s = spec.checked()
    event, link, time, key = name(s.event), f"e.{name(s.link)}", f"CAST(e.{name(s.time)} AS TIMESTAMP_NTZ)", name(s.entity_key)
    hit = "TRUE" if s.filter is None else f"e.{name(s.filter.column)} {s.filter.op} {_literal(s.filter.value)}"
    value = f"e.{name(s.value)}" if s.value else "1"
    ahead = f"{time} > t.timestamp AND {time} <= t.timestamp + INTERVAL '{s.horizon_days}' DAY"
    more = "" if s.threshold is None or s.op != "count" else f" > {_literal(s.threshold)}"
    number = lambda x: f"CAST({x}{more} AS INT)" if more else x
    if s.population == "in_window":
        target = {"exists": f"MAX(CASE WHEN {hit} THEN 1 ELSE 0 END)", "count": number(f"COUNT(CASE WHEN {hit} THEN 1 END)"), "sum": f"SUM(CASE WHEN {hit} THEN {value} ELSE 0 END)", "mean": f"AVG(CASE WHEN {hit} THEN {value} END)"}[s.op]
        having = f"\nHAVING {target} IS NOT NULL" if s.op == "mean" else ""
        return f"SELECT t.timestamp, {link} AS {key}, {target} AS target\nFROM timestamp_df t JOIN {event} e ON {ahead}\nWHERE {link} IS NOT NULL\nGROUP BY t.timestamp, {link}{having}"
    behind = f"{time} > t.timestamp - INTERVAL '{s.past_days}' DAY AND {time} <= t.timestamp"
    who = f"SELECT t.timestamp, x.{key} AS k FROM timestamp_df t CROSS JOIN {name(s.entity)} x"
    if s.population == "recent":
        who += f" LEFT SEMI JOIN (SELECT t.timestamp AS seen, {link} AS known FROM timestamp_df t JOIN {event} e ON {behind}) ON seen = t.timestamp AND known = x.{key}"
    found = "SUM({0})".format(value) if s.op == "sum" else "COUNT(*)"
    target = {"not_exists": "CAST(found IS NULL AS INT)", "exists": "CAST(found IS NOT NULL AS INT)", "count": number("COALESCE(found, 0)"), "sum": "COALESCE(found, 0)"}[s.op]
    return (
        f"WITH who AS ({who}),\nhits AS (SELECT t.timestamp, {link} AS k, {found} AS found FROM timestamp_df t JOIN {event} e ON {ahead} AND {hit} GROUP BY t.timestamp, {link})\n"
        f"SELECT timestamp, k AS {key}, {target} AS target\nFROM who LEFT JOIN hits USING (timestamp, k)"
    )


#: Names of task types in the file format (fixed values).
TASK_TYPES = {"binary": "binary_classification", "regression": "regression"}


def task_manifest(spec: LabelSpec, val: datetime, test: datetime, database: str = "db.json") -> dict[str, Any]:
    """The task as a file states it (fixed keys of the file format), with the labels' query and where the database is described."""
    when = "%Y-%m-%d %H:%M:%S"
    return {
        "database": database, "entity_table": spec.entity, "entity_col": spec.entity_key, "time_col": "timestamp", "target_col": "target", "task_type": TASK_TYPES[spec.task_type],
        "timedelta": f"{spec.horizon_days} days", "num_eval_timestamps": 1, "val_timestamp": val.strftime(when), "test_timestamp": test.strftime(when), "query": label_query(spec),
    }


def live_manifest(task: dict[str, Any], end: datetime, horizon_days: int) -> dict[str, Any]:
    """The same task moved so that its test window begins where the data end."""
    when = "%Y-%m-%d %H:%M:%S"
    return task | {"val_timestamp": (end - timedelta(days=horizon_days)).strftime(when), "test_timestamp": end.strftime(when)}
