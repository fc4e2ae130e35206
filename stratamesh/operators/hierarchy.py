"""Parent-child links to full hierarchies by nested sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from stratamesh.operators.skew import BROADCAST_ROWS, hot_groups, lookup, small
from stratamesh.session import cut, cut_by, drop, gather


def listed_parents(rows: DataFrame, *, node: str, parent: str, children: str, updated_at: str) -> DataFrame:
    """``node`` and ``parent`` of each distinct node: its newest row counts, its parent is ``parent`` or else the node
    whose newest row lists it (the least such node). The parent need not have a row."""
    latest = (
        rows.select(F.col(node).alias("node"), F.col(updated_at).alias("t"), F.col(parent).alias("p"), F.col(children).alias("c"))
        .where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.max(F.struct("t", "p", "c")).alias("x"))
        .select("node", "x.p", "x.c")
    )
    told = latest.select(F.col("node").alias("lister"), F.explode("c").alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.min("lister").alias("lister"))
    return latest.join(told, "node", "left").select("node", F.coalesce("p", "lister").alias("parent"))


def resolve_parents(rows: DataFrame, *, node: str, parent: str, children: str, updated_at: str) -> DataFrame:
    """As ``listed_parents``, a parent that has no row being none."""
    links = cut(listed_parents(rows, node=node, parent=parent, children=children, updated_at=updated_at))
    there = links.select(F.col("node").alias("parent")).join(links.select("parent").where("parent IS NOT NULL").distinct(), "parent", "left_semi")
    met = lookup(links, there.withColumn("is_there", F.lit(True)), "parent", hot_groups(links.where("parent IS NOT NULL"), ["parent"], WIDE), "node")
    return met.select("node", F.when(F.col("is_there"), F.col("parent")).alias("parent"))


#: Rows of one key that one task may join; more are spread.
WIDE = 1_000_000
#: Children of one parent that are put in order together; the pieces of a wider family are added up.
PIECE = 200_000


def _hot(asked: DataFrame, key: str, wide: int) -> DataFrame | None:
    hot, n = small(asked.where(F.col("asks") > wide).select(key, F.ceil(F.col("asks") / wide).cast("int").alias("_parts")))
    return None if not n else hot if n <= BROADCAST_ROWS else cut(hot)


def _counts_below(inner: DataFrame, wide: int) -> tuple[DataFrame, list[DataFrame | None]]:
    """``node, kids, n`` of every node that has children, ``n`` counting all below it, ``loose`` where it is in or below a
    loop; and the hot ancestors of each round. In round k a node gives what it has counted to its ancestor 2^k steps
    up; afterwards it has counted all that lies nearer than 2^(k+1). Nodes that hang from a root run out of ancestors;
    those that still have one when a round ends none are loose (among nodes below roots each round ends some). A node
    without an ancestor that nothing was given to is done and leaves the frame."""
    s = cut(inner.select("node", "kids", "up", F.col("kids").alias("n")))
    done: list[DataFrame] = []
    hots: list[DataFrame | None] = []
    before = -1
    while True:
        given = s.where("up IS NOT NULL").groupBy("up").agg(F.sum("n").alias("more"), F.count(F.lit(1)).alias("asks"))
        asked = cut(given.join(s.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up", "left"))
        now, most = asked.agg(F.sum("asks"), F.max("asks")).first()
        if now in (None, before):
            drop(asked)
            break
        hots.append(_hot(asked, "up", wide) if most > wide else None)
        moved = lookup(s, asked.select("up", "up2"), "up", hots[-1], "node").select("node", "kids", F.col("up2").alias("up"), "n")
        got = moved.join(asked.select(F.col("up").alias("node"), "more"), "node", "left")
        live, ended = cut_by(got.select("node", "kids", "up", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), (F.col("up").isNotNull() | F.col("more").isNotNull()).alias("live")), "live")
        drop(s, asked)
        done.append(ended)
        s, before = live, now
    return gather([*done, s]).select("node", "kids", F.col("up").isNotNull().alias("loose"), "n"), hots


def _offsets(children: DataFrame, widest: int, piece: int) -> DataFrame:
    """Adds ``off``, the preorder position relative to the parent: 1 plus the subtree sizes of the siblings before. The
    children of a family of over ``piece`` are ordered in pieces, whose totals are added up."""
    d = children.withColumn("piece", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("kids") / piece))))
    inner = Window.partitionBy("parent", "piece").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    near = d.withColumn("off", 1 + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    if widest <= piece:
        return near.drop("piece")
    outer = Window.partitionBy("parent").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.where(F.col("kids") > piece).groupBy("parent", "piece").agg(F.sum("n").alias("t"))
    starts = totals.select("parent", "piece", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("start"))
    return near.join(starts, ["parent", "piece"], "left").withColumn("off", F.col("off") + F.coalesce("start", F.lit(0))).drop("piece", "start")


def nested_sets(links: DataFrame, *, with_path: bool = False, wide: int = WIDE, piece: int = PIECE) -> DataFrame:
    """For each ``node`` of ``links`` (``node``, ``parent``; unique nodes): ``root``, ``depth``, ``lo`` and ``hi`` (its
    preorder range within the root's tree, ends included) and ``n_below``; with ``with_path`` also ``path``, the nodes
    from the root down to it. A node's descendants are the nodes of the same root with ``lo`` in its range, its
    ancestors those whose range holds its ``lo``.

    Method: subtree sizes upward, sibling preorder ranges by prefix sums downward. Both passes move only nodes that have
    children and double their step in each round, so a tree of depth d takes about log2(d) rounds and not d; nodes
    without children join their parent once, at the end. Parents and ancestors with over ``wide`` rows are salted.
    Nodes that no pass from a root reaches are in or below a loop: their ``root`` is null and ``depth``, ``lo``, ``hi``,
    ``n_below`` are -1.

    Defined results: an empty table gives none; null nodes are left out; a parent that has no row is none; a node that
    is its own parent is a loop.
    """
    kind = links.schema["node"].dataType
    links = cut(links.where("node IS NOT NULL").select("node", "parent"))
    kids = links.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    families = cut(kids.join(links.select("node", F.col("parent").alias("up"), F.lit(True).alias("is_node")), "node", "left"))
    counted, hots = _counts_below(families.where("is_node"), wide)
    widest = families.agg(F.max("kids")).first()[0] or 0
    hot = _hot(families.select(F.col("node").alias("parent"), F.col("kids").alias("asks")), "parent", wide) if widest > wide else None
    drop(families)

    # every node with its own size and what its parent is: null kids where it has none
    own = links.join(counted.select("node", F.col("n"), F.col("loose").alias("inner_loose")), "node", "left").select("node", "parent", F.col("inner_loose").isNotNull().alias("inner"), (1 + F.coalesce("n", F.lit(0))).alias("n"))
    known = lookup(own, counted.select(F.col("node").alias("parent"), "kids", "loose"), "parent", hot, "node")
    path = [F.array("node").alias("path")] if with_path else []
    roots = known.where("kids IS NULL").select("node", F.lit(None).cast(kind).alias("up"), "inner", "n", F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("depth"), F.col("node").alias("root"), *path)
    below = _offsets(known.where("kids IS NOT NULL AND NOT loose"), widest, piece).select("node", F.col("parent").alias("up"), "inner", "n", F.col("off").cast("bigint").alias("lo"), F.lit(1).cast("bigint").alias("depth"), F.col("parent").alias("root"), *path)
    gone = F.lit(-1).cast("bigint")
    lost = known.where("kids IS NOT NULL AND loose").select("node", F.lit(None).cast(kind).alias("up"), F.lit(False).alias("inner"), F.lit(0).cast("bigint").alias("n"), gone.alias("lo"), gone.alias("depth"), F.lit(None).cast(kind).alias("root"), *([F.lit(None).cast(ArrayType(kind)).alias("path")] if with_path else []))
    moving, still = cut_by(roots.unionByName(below).unionByName(lost).withColumn("moves", F.col("inner") & F.col("up").isNotNull()), "moves")

    def step(s: DataFrame, to: DataFrame, hot: DataFrame | None) -> DataFrame:
        """Rows of ``s`` relative to ``up`` made relative to where ``up`` is itself relative to."""
        u = to.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("lo").alias("lo2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"), *([F.col("path").alias("path2")] if with_path else []))
        return lookup(s, u, "up", hot, "node").select(
            "node", F.col("up2").alias("up"), "inner", "n", (F.col("lo") + F.col("lo2")).alias("lo"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root"), *([F.concat("path2", "path").alias("path")] if with_path else [])
        )

    tables, k = [still], 0
    while moving.inputFiles():
        base = gather(tables).where("inner")
        went, there = cut_by(step(moving, base.unionByName(moving), hots[k]).withColumn("moves", F.col("up").isNotNull()), "moves")
        drop(moving)
        tables.append(there)
        moving, k = went, k + 1
    drop(moving)
    placed = gather(tables).where("inner")
    leaves = step(still.where("NOT inner AND up IS NOT NULL"), placed, hot.withColumnRenamed("parent", "up") if hot is not None else None)
    done = placed.unionByName(still.where("NOT inner AND up IS NULL")).unionByName(leaves)
    n = F.when(F.col("depth") >= 0, F.col("n") - 1).otherwise(-1)
    return done.select("node", "root", "depth", "lo", F.when(F.col("depth") >= 0, F.col("lo") + n).otherwise(-1).alias("hi"), n.alias("n_below"), *(["path"] if with_path else []))


def _bucketed(sets: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ranges`` and the nodes of ``sets`` with buckets ``_k``, ``_b`` of the preorder. A range goes to the buckets of the least power of two over its length, which are two at most,
    and the nodes to their bucket of every size that is in use; so what meets is at most a few times the result."""
    r = ranges.where("lo < hi").withColumn("_k", F.length(F.bin(F.col("hi") - F.col("lo"))))
    r = r.withColumn("_b", F.explode(F.expr("sequence(shiftright(lo + 1, _k), shiftright(hi, _k))")))
    sizes = sorted(x[0] for x in r.select("_k").distinct().collect())
    p = sets.where("root IS NOT NULL").select("root", F.col("node").alias("below"), F.col("lo").alias("at"))
    p = p.withColumn("_k", F.explode(F.lit(sizes).cast("array<int>"))).withColumn("_b", F.expr("shiftright(at, _k)"))
    return r, p


def _in_range(sets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row of ``ranges`` (``node``, ``root``, ``lo``, ``hi``) with each node ``below`` of the root whose ``at`` is in
    ``lo`` + 1 .. ``hi``."""
    r, p = _bucketed(sets, ranges)
    return r.join(p, ["root", "_k", "_b"]).where("at > lo AND at <= hi")


def descendants(sets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``node`` and ``below`` for every node of ``of`` (one column ``node``), or of ``sets``: a range join by buckets of
    the preorder."""
    a = sets.where("root IS NOT NULL").select("node", "root", "lo", "hi")
    if of is not None:
        a = a.join(of.select("node").distinct(), "node", "left_semi")
    return _in_range(sets, a).select("node", "below")


def ancestors(sets: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``node`` and ``above`` for every node of ``of``, or of ``sets``."""
    a = sets if of is None else sets.join(of.select("node").distinct(), "node", "left_semi")
    return _in_range(a, sets.where("root IS NOT NULL").select("node", "root", "lo", "hi")).select(F.col("below").alias("node"), F.col("node").alias("above"))
