"""Navigation trees over parent edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, kept
from .order import numbered

#: Numbers that are sent to all tasks.
FEW = 1_000_000


def roots(edges: DataFrame) -> DataFrame:
    """(id, parent_id, tree_id, depth) from (id, parent_id).

    Pointer doubling: every node knows an ancestor and its distance, and each round
    replaces the ancestor by the ancestor's own, so depth d takes log2(d) rounds of one
    join. A null parent, a parent that is no node, or the node itself makes a root. A cycle
    raises ValueError.
    """
    return rooted(edges.select("id", "parent_id"))


def rooted(edges: DataFrame, numbers: bool = False) -> DataFrame:
    """`edges` (id, parent_id, ...) with tree_id and depth, as `roots` tells them.

    Nodes are numbered, so a round moves three numbers a row and no ids, and only of nodes that have not got to their root. With
    `numbers` they are given too: n, up (the parent's, null for a root) and top (the root's).
    """
    nodes = kept(edges.withColumn("_n", F.monotonically_increasing_id()))  # kept, so the numbers stay what they are
    known = nodes.groupBy(F.col("id").alias("_i")).agg(F.min("_n").alias("_p"))
    given = nodes.where("parent_id IS NOT NULL AND parent_id <> id").select("_n", "parent_id")
    state = climbed(given.join(known, F.col("parent_id") == F.col("_i")).select(F.col("_n").alias("n"), F.col("_p").alias("up")))
    named = nodes.select(F.col("_n").alias("top"), F.col("id").alias("tree_id"))
    below = state.join(named, "top")
    told = ["n", "up", "top"] if numbers else []
    return nodes.join(below.withColumnRenamed("n", "_m"), F.col("_n") == F.col("_m"), "left").select(
        *edges.columns, F.coalesce("tree_id", "id").alias("tree_id"), F.coalesce("far", F.lit(0)).cast("long").alias("depth"),
        F.col("_n").alias("n"), "up", F.coalesce("top", "_n").alias("top"),
    ).select(*edges.columns, "tree_id", "depth", *told)


def climbed(links: DataFrame) -> DataFrame:
    """(n, up, top, far) of numbered nodes with a parent (n, up): the root of each, and how far it is. A cycle raises ValueError."""
    state = kept(links.select("n", "up", F.col("up").alias("top"), F.lit(1).cast("long").alias("far")))
    active, done = state, None
    # the longest path has fewer steps than nodes, so what still moves after this runs in a cycle
    moving = state.count()
    for _ in range(moving.bit_length() + 1):
        if not moving:
            break
        rows = active if done is None else active.unionByName(done)
        jump = rows.select(F.col("n").alias("top"), F.col("top").alias("top2"), F.col("far").alias("far2"))
        if moving <= FEW:  # the last rounds ask for few rows, and no others are moved
            jump = jump.join(F.broadcast(active.select("top")), "top", "left_semi")
        new = kept(active.join(jump, "top", "left").select("n", "up", F.coalesce("top2", "top").alias("top"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("top2").isNotNull().alias("moved")))
        if new.where("moved and n = top").head(1):
            raise ValueError("the parent edges contain a cycle")
        # a node whose ancestor has none itself is there
        still = new.where("NOT moved").drop("moved")
        done = still if done is None else done.unionByName(still)
        active = new.where("moved").drop("moved")
        moving = active.count()
    else:
        if moving:
            raise ValueError("the parent edges contain a cycle")
    return state if done is None else done


def tree_times(members: DataFrame) -> DataFrame:
    """(tree_id, first_load_time, latest_activity_time, members) of visits with tree_id and page_loaded_at."""
    return members.groupBy("tree_id").agg(
        F.min("page_loaded_at").alias("first_load_time"), F.max("page_loaded_at").alias("latest_activity_time"),
        F.count("*").alias("members"),
    )


def recent(members: DataFrame, excluded: str | None = None, limit: int = 5, skip: int = 0) -> DataFrame:
    """Members of the `limit` most recently active trees, without one and after the `skip` newest, in tree and time order."""
    t = tree_times(members)
    if excluded is not None:
        t = t.where(F.col("tree_id") != excluded)
    top = t.orderBy(F.desc("latest_activity_time"), "tree_id").offset(skip).limit(limit)
    return members.join(F.broadcast(top.select("tree_id")), "tree_id", "left_semi").orderBy("tree_id", "page_loaded_at", "id")


def orphan_roots(members: DataFrame) -> DataFrame:
    """Members whose parent is named but is no member of the tree."""
    known = members.select(F.col("id").alias("parent_id"), "tree_id")
    return members.where(F.col("parent_id").isNotNull()).join(known, ["parent_id", "tree_id"], "left_anti")


def in_time_order(members: DataFrame, line: Column) -> DataFrame:
    """(tree_id, position, line): a tree's members from the earliest on, numbered from 0.

    Members are numbered by day, each day from the count of those before it, so a huge tree
    spreads over as many tasks as it has days. Times are ISO texts; null times come first.
    """
    day = F.coalesce(F.substring("page_loaded_at", 1, 10), F.lit(""))
    rows = members.select("tree_id", "page_loaded_at", "id", line.alias("line"), day.alias("_day"))
    sizes = members.groupBy("tree_id", day.alias("_day")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("tree_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tree_id", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("tree_id", "_day").orderBy("page_loaded_at", "id"))
    return rows.withColumn("_nth", nth).join(starts, ["tree_id", "_day"]).select(
        "tree_id", (F.col("_start") + F.col("_nth") - 1).cast("int").alias("position"), "line"
    )


def children(members: DataFrame) -> DataFrame:
    """(tree_id, parent_id, children): the ids of each parent's children, in time order."""
    return members.where(F.col("parent_id").isNotNull()).groupBy("tree_id", "parent_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("page_loaded_at", "id"))), lambda x: x["id"]).alias("children")
    )


def built(members: DataFrame) -> DataFrame:
    """(tree_id, root_id, parent_id, id, nth): each tree as it hangs from its first root.

    A member without a parent in its own tree is a root; the first one in time order, then by id, is the tree's, and what hangs from
    the others is left out. `nth` numbers a parent's children in time order, a day at a time, so a parent may have any number. A
    tree without a root is a cycle and raises ValueError.
    """
    m = kept(members.select("tree_id", "id", "parent_id", "page_loaded_at").withColumn("n", F.monotonically_increasing_id()))
    inside = m.select(F.col("tree_id").alias("_t"), F.col("id").alias("_p"), F.col("n").alias("up"))
    links = m.join(inside, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_p"))).select("n", "up")
    placed = hung(m, links, F.substring("page_loaded_at", 1, 10), ["page_loaded_at", "id"])
    ids = m.select("n", "id")
    return (
        placed.select("tree_id", "n", "up", "root", "id", "nth").join(ids.select(F.col("n").alias("root"), F.col("id").alias("root_id")), "root")
        .join(ids.select(F.col("n").alias("up"), F.col("id").alias("parent_id")), "up", "left").select("tree_id", "root_id", "parent_id", "id", "nth")
    )


def hung(members: DataFrame, links: DataFrame, bucket: Column, order: list[str | Column]) -> DataFrame:
    """Numbered members (n, tree_id, ...) that hang from their tree's first root in `order`, with up, root and nth; see `built`.

    `links` are (n, up) inside of trees, and `bucket` must not run against the order. Only numbers climb.
    """
    state = climbed(links)
    tops = members.join(state, "n", "left_anti")
    first = kept(tops.groupBy("tree_id").agg(F.min(F.struct(*order, F.col("n").alias("_n")))["_n"].alias("root")).select("root"))
    rows = first.select(F.col("root").alias("n"), F.lit(None).cast("long").alias("up"), "root").unionByName(
        state.withColumnRenamed("top", "root").join(first, "root").select("n", "up", "root")
    )
    out = members.join(rows, "n")
    return numbered(out, ["tree_id", "up"], bucket, [F.asc(c) if isinstance(c, str) else c.asc() for c in order], "nth").withColumn("nth", F.col("nth").cast("int"))


def preorder(members: DataFrame, steps: int = 40) -> DataFrame:
    """(tree_id, id, path): an array that sorts a tree's members before their descendants, siblings in time order.

    A path holds each ancestor's place among its siblings, from the root down, see `paths`.
    """
    m = cut(members.select("tree_id", "id", "page_loaded_at", "parent_id").withColumn("n", F.monotonically_increasing_id()))
    above = m.select(F.col("tree_id").alias("_t"), F.col("id").alias("_i"), F.col("n").alias("up"))
    hung = m.where("id <> tree_id").join(above, (F.col("tree_id") == F.col("_t")) & (F.col("parent_id") == F.col("_i"))).select("n", "up")
    found = paths(m.join(hung, "n", "left").select("n", "up", "tree_id", "page_loaded_at", "id"), "tree_id", steps)
    return m.select("n", "tree_id", "id").join(found, "n").select("tree_id", "id", "path")


def paths(placed: DataFrame, tree: str, steps: int = 40) -> DataFrame:
    """(n, path) of numbered members (n, up, page_loaded_at, id and the `tree` they are of); a null `up` is a top one.

    Paths double their length each round, like the pointers of `rooted`, so a tree of any depth below 2^`steps` takes a few joins
    of numbers.
    """
    family = F.coalesce(F.col("up").cast("string"), F.concat(F.lit("of "), F.col(tree).cast("string")))
    rows = placed.select("n", "up", family.alias("family"), "page_loaded_at", "id")
    nth = numbered(rows, ["family"], F.substring("page_loaded_at", 1, 10), [F.asc("page_loaded_at"), F.asc("id")], "nth")
    state = cut(nth.select("n", "up", F.array("nth").alias("path")))
    active, done = state.where("up IS NOT NULL"), state.where("up IS NULL")
    for _ in range(steps):
        if active.isEmpty():
            return done.select("n", "path")
        above = active.unionByName(done).select(F.col("n").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        new = cut(active.join(above, "up").select("n", F.col("_up").alias("up"), F.concat("_path", "path").alias("path")))
        active, done = new.where("up IS NOT NULL"), done.unionByName(new.where("up IS NULL"))
    raise ValueError("the parent edges contain a cycle")
