"""Ordered replay of events: state folds and counterfactuals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamesh.operators.temporal import OPEN


def event_fold(changes: DataFrame, *, unit: str, date: str, seq: str, kind: str) -> DataFrame:
    """The ordered state machine of each unit: every change with ``exists_before`` and ``verdict``: ok, or why it is
    impossible (created twice, changed while it does not exist). Existence before a change is that after the last
    create or dissolve before it, possible or not."""
    w = Window.partitionBy(unit).orderBy(date, seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(kind) == "create", True).when(F.col(kind) == "dissolve", False), ignorenulls=True).over(w)
    return changes.withColumn("exists_before", F.coalesce(last, F.lit(False))).withColumn(
        "verdict", F.when((F.col(kind) == "create") & F.col("exists_before"), "exists already").when((F.col(kind) != "create") & ~F.col("exists_before"), "does not exist").otherwise("ok")
    )


REPLAY = "unit string, valid_from string, valid_to string, name string, status string, sovereign string"
SKIPPED = "event string, date string, reason string"


def _replay(base: pd.DataFrame, events: pd.DataFrame) -> tuple[list[list], list[tuple]]:
    """Base rows changed by whole scenario events in order; an event with an unmet condition is left out whole."""
    fields = ["name", "status", "sovereign"]
    by_date: dict[str, list[tuple[int, str, list[dict]]]] = {}
    for r in base.sort_values(["valid_from", "unit"], kind="stable").to_dict("records"):
        by_date.setdefault(r["valid_from"], []).append((1, "", [r | {"kind": "begin"}]))
        if r["valid_to"]:
            by_date.setdefault(r["valid_to"], []).append((0, "", [r | {"kind": "end"}]))
    for (date, event), g in events.sort_values(["date", "event", "seq"], kind="stable").groupby(["date", "event"], sort=True):
        by_date.setdefault(date, []).append((2, event, g.to_dict("records")))
    open_: dict[str, dict] = {}
    overrides: dict[str, dict] = {}  # fields that the scenario has set: they outlast later base rows
    gone: set[str] = set()
    out, skipped = [], []

    def put(unit: str, date: str, values: dict | None) -> None:
        old = open_.pop(unit, None)
        if old is not None and values is not None and all(old[f] == values[f] for f in fields):
            open_[unit] = old
            return
        if old is not None and old["valid_from"] < date:
            out.append([unit, old["valid_from"], date, *[old[f] for f in fields]])
        if values is not None:
            open_[unit] = {"valid_from": date, **{f: values[f] for f in fields}}

    for date in sorted(by_date):
        day = sorted(by_date[date], key=lambda x: (x[0], x[1]))
        begun = {c[2][0]["unit"] for c in day if c[0] == 1}
        for order, event, rows in day:
            if order == 0:
                if rows[0]["unit"] not in begun and rows[0]["unit"] not in gone:
                    put(rows[0]["unit"], date, None)
            elif order == 1:
                if rows[0]["unit"] not in gone:
                    put(rows[0]["unit"], date, {f: rows[0][f] for f in fields} | overrides.get(rows[0]["unit"], {}))
            else:
                there = set(open_)
                reason = ""
                for c in rows:
                    if c["kind"] == "create" and c["unit"] in there:
                        reason = reason or f"{c['unit']} exists already"
                    elif c["kind"] != "create" and c["unit"] not in there:
                        reason = reason or f"{c['unit']} does not exist"
                    (there.discard if c["kind"] == "dissolve" else there.add)(c["unit"])
                if reason:
                    skipped.append((event, date, reason))
                    continue
                for c in rows:
                    given = {f: c[f] for f in fields if c.get(f) is not None}
                    if c["kind"] == "dissolve":
                        put(c["unit"], date, None)
                        gone.add(c["unit"])
                    else:
                        gone.discard(c["unit"])
                        overrides.setdefault(c["unit"], {}).update(given)
                        now = open_.get(c["unit"]) or dict.fromkeys(fields)
                        put(c["unit"], date, {f: now[f] for f in fields} | given)
    out.extend([u, s["valid_from"], None, *[s[f] for f in fields]] for u, s in open_.items())
    return out, skipped


def scenario_replay(base: DataFrame, events: DataFrame, *, runs: list[str], report: bool = False) -> DataFrame:
    """The rows of a history in which scenario events also happen, or with ``report`` the events that could not.

    ``base``: unit, valid_from, valid_to, name, status, sovereign. ``events``: date, event, seq, kind, unit and the
    three fields (null: not set). Both carry the columns ``runs``; each run is one ordered fold over all its units, as
    an event is taken or left out as a whole, so runs are what is parallel. Scenario events come after those of the
    base on the same date; base rows that begin later keep what the scenario has set.
    """
    keys = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in runs)
    cols = ["unit", "valid_from", "valid_to", "name", "status", "sovereign"]

    def run(key: tuple, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        b, e = (x.astype(object).where(x.notna(), None) for x in (b, e))
        rows, skipped = _replay(b, e)
        df = pd.DataFrame(skipped, columns=["event", "date", "reason"]) if report else pd.DataFrame(rows, columns=cols)
        for c, v in zip(reversed(runs), reversed(key)):
            df.insert(0, c, v)
        return df

    return base.groupBy(*runs).cogroup(events.groupBy(*runs)).applyInPandas(run, f"{keys}, {SKIPPED if report else REPLAY}")


def coverage_check(rows: DataFrame, days: DataFrame, weight: str, total: float, tolerance: float) -> DataFrame:
    """Days on which the weights of the valid rows miss ``total`` by more than ``tolerance`` of it."""
    end = F.coalesce("valid_to", F.lit(OPEN))
    j = days.join(rows, (F.col("valid_from") <= F.col("day")) & (F.col("day") < end), "left").groupBy("day").agg(F.coalesce(F.sum(weight), F.lit(0)).alias("sum"))
    return j.where(F.abs(F.col("sum") - total) > tolerance * total)
