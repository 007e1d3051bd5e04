"""Trees of any depth, kept as rows (id, parent), by pointer doubling.

Every node knows an ancestor and what lies between; a round replaces the ancestor by that one's own, so rounds
follow the logarithm of the depth.  A round's rows are written, and only nodes that haven't arrived go on.

Null ids are left out; of an id's rows the one of the smallest parent counts; a parent that is no id is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.skew import least, lookup, meet
from quillmark.sources.shared import settle

#: Among so few nodes no key is too large for a task, and none need wait.
FEW = 100_000


def _asked(nodes: DataFrame, id_col: str, parent: str, *more: str) -> DataFrame:
    """id, at (its parent, an id or not), more, and _n, how many rows name it as their parent: a row an id, by one exchange."""
    rows = nodes.where(F.col(id_col).isNotNull()).select(F.struct(F.col(id_col).alias("id"), F.col(parent).alias("at"), *more, F.lit(True).alias("_own")).alias("x"))
    asks = F.struct(F.col("x.at").alias("id"), F.lit(None).alias("at"), *(F.lit(None).alias(c) for c in more), F.lit(False).alias("_own"))
    both = rows.select(F.explode(F.array("x", asks)).alias("x")).select("x.*").where("id is not null")
    if more:
        first = [F.min_by(F.struct("at", *more), F.when(F.col("_own"), F.struct(F.col("at").isNull(), "at"))).alias("x")]
    else:  # fixed widths are counted by hash, without sorting
        first = [F.min("at").alias("at")]
    held = both.groupBy("id").agg(*first, F.max("_own").alias("_own"), F.count_if(~F.col("_own")).alias("_n")).where("_own")
    return settle(held.select("id", "x.*" if more else "at", "_n"))


def _counts(held: DataFrame) -> tuple[int, int, int, int | None, int]:
    """Of `_asked`: nodes, those with a parent, those asked for, the most that ask for one, and those asked for that have a parent."""
    return held.agg(F.count("*"), F.count("at"), F.count_if(F.col("_n") > 0), F.max("_n"), F.count_if(F.expr("_n > 0 AND at IS NOT NULL"))).first()


def _follow(rows: DataFrame, ends: DataFrame, common: DataFrame | None, sep: str, also: str) -> DataFrame:
    """Each of ``rows`` goes on from its `at` to where that one is in ``ends``, and takes over its ``also``."""
    ends = ends.select(F.col("id").alias("at"), *(F.col(c).alias(f"_{c}") for c in ("far", "depth", "path", also)))
    depth = F.col("depth") + F.coalesce(F.col("_depth") + 1, F.lit(0))  # an `at` that is no id is none
    path = F.coalesce(F.concat("_path", F.lit(sep), "path"), "_path", "path")
    return meet(rows, ends, "at", common).select("id", F.coalesce("_far", "far").alias("far"), depth.alias("depth"), path.alias("path"), F.col(f"_{also}").alias(also))


def climb(nodes: DataFrame, id_col: str, parent: str, name: str | None = None, sep: str = "/") -> DataFrame:
    """id, root, depth (0 for a root), cyclic, and the path of names from the root if ``name`` is given; null names are left out.

    Below or in a cycle: no root, depth or path.

    Where others point to at most half of the nodes, rounds go on with those alone, and all the nodes meet the outcome once in the
    end.  So rounds shrink as trees branch, and most whole paths are made once and not written.
    Of the nodes that haven't arrived and aren't below a cycle the topmost arrives in the next round; where none does, all are cyclic."""
    plain = name in (None, id_col)
    held = _asked(nodes, id_col, parent) if plain else _asked(nodes.withColumn("_path", F.col(name).cast("string")), id_col, parent, "_path")
    label = F.lit(None).cast("string") if name is None else F.col("id").cast("string") if plain else F.col("_path")
    # `at` is the ancestor that the node points to, null once it has arrived; `far` the last one before it, `depth` steps up
    begin = lambda df: df.select("id", "at", F.coalesce("id", "at").alias("far"), F.lit(0).cast("bigint").alias("depth"), label.alias("path"))
    state = begin(held)
    size, active, n, most, rest = _counts(held)
    common = held.where(F.col("_n") > least(size)).select(F.col("id").alias("at")) if n and most > least(size) else None
    waiting = []
    if active and 2 * n <= size:
        waiting.append((state, common))
        state, size, active = begin(held.where("_n > 0")), n, rest
    while active:
        moved = settle(_follow(state.where("at is not null"), state, common, sep, "at"))
        before, common = active, None
        state = state.where("at is null").unionByName(moved)
        if size <= FEW:
            active = moved.where("at is not null").count()
        else:
            asked = settle(moved.where("at is not null").groupBy("at").agg(F.count("*").alias("_n")))
            n, active, most = asked.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n")).first()
            common = asked.where(F.col("_n") > least(size)).select("at") if n and most > least(size) else None
        if active == before:
            break
        if size > FEW and active and 2 * n <= size:
            waiting.append((state, common))
            state = settle(state.join(asked.select(F.col("at").alias("id")), "id", "left_semi"))
            size, active = state.agg(F.count("*"), F.count("at")).first()
    ends = state.withColumn("cyclic", F.col("at").isNotNull()).drop("at")
    for i, (state, common) in enumerate(reversed(waiting)):
        here = state.where("at is null").withColumn("cyclic", F.lit(False)).drop("at")
        ends = ends if common is None or i == 0 else settle(ends)  # common keys read it twice
        below = _follow(state.where("at is not null"), ends, common, sep, "cyclic")
        ends = here.unionByName(below.withColumn("cyclic", F.coalesce("cyclic", F.lit(False))))
    fine = lambda c: F.when(~F.col("cyclic"), F.col(c))
    out = ends.select(F.col("id").cast(nodes.schema[id_col].dataType).alias(id_col), fine("far").alias("root"), fine("depth").alias("depth"), fine("path").alias("path"), "cyclic")
    return out if name else out.drop("path")


def subtree_sums(nodes: DataFrame, id_col: str, parent: str, value: str) -> DataFrame:
    """id and total: the sum of the values of a node and of everything below it; nulls count for nothing, and without
    any value the total is null.  Below or in a cycle totals are null.

    After k rounds a node has the sum of what lies less than 2**k steps below, and adds those of the nodes that many
    steps below; these are summed by their ancestor before they meet it.  Where at least half of the nodes are leaves, these
    give their values to their parents first and take no part in the rounds."""
    held = _asked(nodes.withColumn("_value", F.col(value)), id_col, parent, "_value")
    held = held.withColumnRenamed("_value", "total")
    size, active, n, _, rest = _counts(held)
    kind = held.schema["total"].dataType
    added = lambda rows, more: rows.join(more, "id", "left").withColumn("total", F.coalesce(F.try_add("total", "_more"), "total", "_more").cast(kind)).select("id", "at", "total")
    sums = lambda rows: rows.groupBy(F.col("at").alias("id")).agg(F.try_sum("total").alias("_more"))
    state, leaves = held.select("id", "at", "total"), None
    if active and 2 * n <= size:
        leaves = held.where("_n = 0").select("id", "at", "total")
        state = settle(added(held.where("_n > 0"), sums(leaves.where("at is not null"))))
        size, active = n, rest
    cyclic = False
    while active and not cyclic:
        going = state.where("at is not null")
        ups = state.select(F.col("id").alias("at"), F.col("at").alias("_at"))
        moved = lookup(going, ups, "at", size) if size > FEW else meet(going, ups, "at", None)
        moved = moved.withColumn("at", F.col("_at")).drop("_at").unionByName(state.where("at is null"))
        state = settle(added(moved, sums(going)))
        before, active = active, state.where("at is not null").count()
        cyclic = active == before  # see `climb`
    state = state if leaves is None else state.unionByName(leaves)
    if cyclic:  # what never arrives, and so what it was added to, has no total
        fine = climb(nodes, id_col, parent).where("not cyclic").select(F.col(id_col).alias("id"))
        state = state.join(fine.withColumn("_fine", F.lit(True)), "id", "left").withColumn("total", F.when(F.col("_fine"), F.col("total"))).drop("_fine")
    return state.select(F.col("id").cast(nodes.schema[id_col].dataType).alias(id_col), "total")
