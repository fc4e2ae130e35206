"""Full history of changing entity attributes, folded from change events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamesh.functions.text import canonical
from stratamesh.operators.skew import hot_groups

_KEPT = "\x00kept"  # marks a field that a run of changes leaves alone
_CREATE, _ALTER, _DISSOLVE = 0, 1, 2


def _state(on: Column, values: list[Column]) -> Column:
    return F.struct(on.alias("on"), *[v.cast("string").alias(f"f{i}") for i, v in enumerate(values)])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (lambdas know no common subexpressions)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _apply(st: Column, x: Column, n: int) -> Column:
    """State after change ``x``."""
    on, k = st["on"], x["k"]
    made = (k == _CREATE) & ~on
    touched = on & (k != _DISSOLVE)

    def field(i: int) -> Column:
        named = x["m"].bitwiseAND(F.lit(1 << i)) != 0
        return (
            F.when(k == _DISSOLVE, F.lit(None).cast("string"))
            .when(made, F.when(named, x[f"v{i}"]))
            .when(touched & named, x[f"v{i}"])
            .otherwise(st[f"f{i}"])
        )

    return _state((k == _CREATE) | (on & (k == _ALTER)), [field(i) for i in range(n)])


def _fold(arr: Column, start: Column, n: int, point: T.StructType, block: int) -> Column:
    """Struct of the last state ``st`` and ``out``, the points (day, state) at whose end the state is another one
    than before. A block's points are appended to a short array and blocks to the list of blocks, so appending to a
    long history does not copy it each time."""
    none = F.from_json(F.lit("[]"), T.ArrayType(point))
    nones = F.from_json(F.lit("[]"), T.ArrayType(T.ArrayType(point)))

    def step(acc: Column, x: Column) -> Column:
        def then(st: Column) -> Column:
            new = x["last"] & ~st.eqNullSafe(acc["pub"])
            return F.struct(
                st.alias("st"),
                F.when(new, st).otherwise(acc["pub"]).alias("pub"),
                F.when(new, F.concat(acc["out"], F.array(F.struct(x["d"].alias("d"), st.alias("st"))))).otherwise(acc["out"]).alias("out"),
            )

        return _let(_apply(acc["st"], x, n), then)

    def blocks(acc: Column, b: Column) -> Column:
        inner = F.aggregate(
            F.slice(arr, b * block + 1, block),
            F.struct(acc["st"].alias("st"), acc["pub"].alias("pub"), none.alias("out")),
            step,
        )
        return _let(inner, lambda r: F.struct(r["st"].alias("st"), r["pub"].alias("pub"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    whole = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / F.lit(block)).cast("int")),
        F.struct(start.alias("st"), start.alias("pub"), nones.alias("out")),
        blocks,
    )
    return _let(whole, lambda r: F.struct(r["st"].alias("st"), F.flatten(r["out"]).alias("out")))


def _last_state(arr: Column, start: Column, n: int) -> Column:
    return F.aggregate(arr, start, lambda st, x: _apply(st, x, n))


def build_history(
    changes: DataFrame,
    *,
    entity: str,
    date: str,
    change: str,
    known_at: str,
    kind: str,
    fields: list[str],
    fields_set: str,
    max_group_rows: int = 200_000,
    block: int = 256,
) -> DataFrame:
    """Every period in which an entity existed with the same attribute values: ``entity``, ``fields``, ``valid_from``,
    ``valid_to`` (dates; ``valid_to`` exclusive, null while open).

    Method: one row per ``change`` (the one known last), per entity a sorted array of structs folded by a higher-order
    function that appends a version only where the state at the end of a day differs from the one before, then the
    versions exploded with the next version's start as end. An entity with over ``max_group_rows`` changes is cut into
    runs of days: each run is folded to its effect, the effects are composed to every run's start state, and the runs
    are folded apart, so no group is unbounded (a single day of one entity is never cut).

    Defined results: no rows for an empty table; rows with null ``change``, ``entity`` or ``kind``, or with no valid
    date, count for nothing; exact repeats and ties on ``known_at`` are settled by the greatest row; null
    ``fields_set`` sets nothing; unknown kinds do nothing; values are compared and given in canonical form (NFC,
    trimmed, single spaces); empty text is a value other than null; other columns, whatever their names, are not read.
    """
    n = len(fields)
    src = changes.select(
        F.col(entity).alias("e"),
        F.col(change).alias("s"),
        F.col(known_at).alias("r"),
        F.expr(f"try_cast(`{date}` AS date)").alias("d"),
        F.when(F.col(kind) == "create", _CREATE).when(F.col(kind).isin("alter", "rename"), _ALTER).when(F.col(kind) == "dissolve", _DISSOLVE).alias("k"),
        reduce(
            lambda a, b: a + b,
            [F.when(F.array_contains(F.col(fields_set), f), 1 << i).otherwise(0) for i, f in enumerate(fields)],
        ).cast("int").alias("m"),
        *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)],
    )
    rest = ["e", "d", "k", "m", *[f"v{i}" for i in range(n)]]
    one = (
        src.where("s IS NOT NULL")
        .groupBy("s")
        .agg(F.max(F.struct("r", *rest)).alias("x"))
        .select("s", *[F.col(f"x.{c}").alias(c) for c in rest])
        .where("e IS NOT NULL AND d IS NOT NULL AND k IS NOT NULL")
        .select("e", "s", "d", "k", "m", *[canonical(F.col(f"v{i}")).alias(f"v{i}") for i in range(n)])
    )
    state = T.StructType([T.StructField("on", T.BooleanType()), *[T.StructField(f"f{i}", T.StringType()) for i in range(n)]])
    point = T.StructType([T.StructField("d", T.DateType()), T.StructField("st", state)])
    off = _state(F.lit(False), [F.lit(None)] * n)

    def grouped(df: DataFrame, *keys: str) -> DataFrame:
        arr = F.array_sort(F.collect_list(F.struct("d", "s", "k", "m", *[f"v{i}" for i in range(n)])))
        g = df.groupBy(*keys).agg(arr.alias("a"))
        ended = F.transform(
            "a",
            lambda x, i: F.struct(
                x["d"].alias("d"), x["k"].alias("k"), x["m"].alias("m"), *[x[f"v{j}"].alias(f"v{j}") for j in range(n)],
                (~x["d"].eqNullSafe(F.get(F.col("a"), i + 1)["d"])).alias("last"),
            ),
        )
        return g.select(*keys, ended.alias("a"))

    def versions(df: DataFrame, after: Column) -> DataFrame:
        """From ``p``, the points of a run; ``after``: the day of the first point behind the run."""
        v = F.filter(
            F.transform("p", lambda c, i: F.struct(c["st"].alias("st"), c["d"].alias("a"), F.coalesce(F.get(F.col("p"), i + 1)["d"], after).alias("b"))),
            lambda v: v["st"]["on"],
        )
        return df.select("e", F.explode(v).alias("v")).select(
            F.col("e").alias(entity),
            *[F.col(f"v.st.f{i}").alias(f) for i, f in enumerate(fields)],
            F.col("v.a").alias("valid_from"),
            F.col("v.b").alias("valid_to"),
        )

    hot = hot_groups(src.where("e IS NOT NULL"), ["e"], max_group_rows)
    nothing = F.lit(None).cast("date")
    cold = one if hot is None else one.join(hot, "e", "left_anti")
    res = versions(grouped(cold, "e").select("e", _fold(F.col("a"), off, n, point, block)["out"].alias("p")), nothing)
    if hot is None:
        return res

    parts = hot.agg(F.max("_parts")).first()[0]
    mine = one.join(hot, "e", "left_semi")
    day = F.datediff("d", F.lit("1970-01-01"))
    cuts = mine.groupBy("e").agg(F.percentile_approx(day, [i / parts for i in range(1, parts)], 10_000).alias("c"))
    runs = grouped(mine.join(cuts, "e").withColumn("run", F.size(F.filter("c", lambda c: c <= day))), "e", "run")
    # nullable and not foldable: the fold's type comes from its start
    kept = _state(F.lit(True), [F.when(F.size("a") >= 0, _KEPT)] * n)
    effect = runs.select("e", "run", _last_state(F.col("a"), off, n).alias("off"), _last_state(F.col("a"), kept, n).alias("on"))

    def enter(acc: Column, x: Column) -> Column:
        def then(st: Column) -> Column:
            from_on = _state(x["on"]["on"], [F.when(x["on"][f"f{i}"] == _KEPT, st[f"f{i}"]).otherwise(x["on"][f"f{i}"]) for i in range(n)])
            return F.struct(
                F.when(st["on"], from_on).otherwise(x["off"]).alias("st"),
                F.concat(acc["out"], F.array(F.struct(x["run"].alias("run"), st.alias("st")))).alias("out"),
            )

        return _let(acc["st"], then)

    none = F.from_json(F.lit("[]"), T.ArrayType(T.StructType([T.StructField("run", T.IntegerType()), T.StructField("st", state)])))
    starts = (
        effect.groupBy("e")
        .agg(F.array_sort(F.collect_list(F.struct("run", "off", "on"))).alias("x"))
        .select("e", F.explode(F.aggregate("x", F.struct(off.alias("st"), none.alias("out")), enter)["out"]).alias("y"))
        .select("e", "y.run", F.col("y.st").alias("st0"))
    )
    from pyspark.sql import Window

    points = runs.join(starts, ["e", "run"]).select("e", "run", _fold(F.col("a"), F.col("st0"), n, point, block)["out"].alias("p"))
    behind = Window.partitionBy("e").orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    firsts = points.select("e", "run", F.get("p", F.lit(0))["d"].alias("d0"))
    after = firsts.select("e", "run", F.min("d0").over(behind).alias("after"))
    return res.unionByName(versions(points.join(after, ["e", "run"]), F.col("after")))
