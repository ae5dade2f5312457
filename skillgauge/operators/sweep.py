"""Threshold sweeps over a tree (E5, E9, G5, G6, I6, I7) in closed form.

A sweep moves a threshold in steps of `delta` away from the extreme interval bound of the root and
its big children. A node passes the test at step i exactly when i is at most

    last = ceil(distance of its bound from the extreme bound / delta),

so passing is a range of steps, not a table of steps. With its big children it qualifies up to the
least `last` among itself and them; it is extracted after the last step at which any proper ancestor
qualifies. Every profile of the sweep follows from these two numbers per node, and profiles change
only where one of the ranges begins or ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from skillgauge.operators.tree import BIG_CHILD, NODE, parent, prefixes
from skillgauge.session import cut_lineage

# Fixed value: step width of a sweep.
DELTA = 1e-4
# Fixed value: joins the members of a profile when profiles are compared.
SEPARATOR = "[###***###]"


def sweep_start(stats: DataFrame, direction: str = "lower") -> DataFrame:
    """Per tree the extreme bound among the root and its big children."""
    top = stats.filter((F.size("path") == 0) | ((F.size("path") == 1) & (F.col("size") >= BIG_CHILD)))
    extreme = F.max("hi") if direction == "lower" else F.min("lo")
    return top.groupBy("tree_id").agg(extreme.alias("extreme"))


def step_ranges(stats: DataFrame, direction: str = "lower", delta: float = DELTA) -> DataFrame:
    """I6 core: the steps (`after`, `until`] at which each node is extracted, for one interval level.

    `qualifies_until` is the last step at which the node qualifies together with its big children,
    `after` the last step at which a proper ancestor does (-1 if none). Nodes that never qualify are
    left out. Both the node table and the ranges are small next to the leaves and are read several
    times, so they are materialised.
    """
    stats = cut_lineage(stats.filter(F.col("hi").isNotNull()))
    distance = F.col("extreme") - F.col("hi") if direction == "lower" else F.col("lo") - F.col("extreme")
    lasts = (
        stats.join(sweep_start(stats, direction), "tree_id")
        .withColumn("last", F.ceil(distance / F.lit(delta)).cast("int"))
    )
    big_children = (
        lasts.filter((F.size("path") > 0) & (F.col("size") >= BIG_CHILD))
        .groupBy("tree_id", parent(F.col("path")).alias("path"))
        .agg(F.min("last").alias("children_last"))
    )
    qualified = (
        lasts.join(big_children, NODE, "left")
        .withColumn("qualifies_until", F.least("last", "children_last"))
        .filter("qualifies_until >= 0")
        .select(*NODE, "size", "extreme", "qualifies_until")
    )
    above = (
        qualified.select("tree_id", "path", F.explode(prefixes(F.col("path"), proper=True)).alias("_ancestor"))
        .join(
            qualified.select("tree_id", F.col("path").alias("_ancestor"), "qualifies_until"),
            ["tree_id", "_ancestor"],
        )
        .groupBy(*NODE)
        .agg(F.max("qualifies_until").alias("after"))
    )
    return cut_lineage(
        qualified.join(above, NODE, "left")
        .fillna(-1, ["after"])
        .withColumn("until", F.col("qualifies_until"))
    )


def sweep_breakpoints(ranges: DataFrame) -> DataFrame:
    """Steps at which the extracted set changes, with its size, up to the first empty one.

    Bounds lie in [0, 1], so a tree has at most 1 / delta + 2 of these rows; the window runs over
    them, not over nodes.
    """
    live = ranges.filter("until > after")
    changes = live.select(
        "tree_id",
        F.explode(
            F.array(
                F.struct((F.col("after") + 1).alias("step"), F.lit(1).alias("change")),
                F.struct((F.col("until") + 1).alias("step"), F.lit(-1).alias("change")),
            )
        ).alias("_event"),
    )
    per_step = changes.groupBy("tree_id", F.col("_event.step").alias("step")).agg(
        F.sum("_event.change").alias("change")
    )
    by_step = W.partitionBy("tree_id").orderBy("step")
    sizes = per_step.withColumn("profile_size", F.sum("change").over(by_step)).drop("change")
    return first_empty_stop(sizes, "profile_size", ["tree_id"], "step", start=0)


def first_empty_stop(steps: DataFrame, count: str, keys: list[str], order: str, start: int | None = None) -> DataFrame:
    """The steps before the first one with nothing left.

    With `start`, a sweep whose first step is missing is empty from the beginning.
    """
    ordered = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = steps.withColumn("_alive", F.min((F.col(count) > 0).cast("int")).over(ordered))
    if start is not None:
        marked = marked.withColumn("_alive", F.col("_alive") * (F.min(order).over(ordered) <= start).cast("int"))
    return marked.filter("_alive = 1").drop("_alive")


def profile_steps(ranges: DataFrame, descriptions: DataFrame) -> DataFrame:
    """The profile at every breakpoint without its members: tree_id, step, last, profile_size, id_1, id_2.

    It holds from `step` to `last`. The two ids are sums of 64-bit hashes of the members' descriptions: a node adds
    its hashes where it enters and takes them off where it leaves, so they follow from running sums over the
    breakpoints, and equal profiles have equal sizes and ids, wherever they occur.
    """
    live = ranges.filter("until > after").join(descriptions.select(*NODE, "description"), NODE)
    hashed = live.select("tree_id", "after", "until", *[F.xxhash64(F.lit(salt), "description").cast("decimal(38,0)").alias(f"h{salt}") for salt in (1, 2)])
    ends = F.array(F.struct((F.col("after") + 1).alias("step"), F.lit(1).alias("change")), F.struct((F.col("until") + 1).alias("step"), F.lit(-1).alias("change")))
    events = hashed.select("tree_id", "h1", "h2", F.inline(ends))
    per_step = events.groupBy("tree_id", "step").agg(F.sum("change").alias("n"), *[F.sum(F.when(F.col("change") > 0, F.col(h)).otherwise(-F.col(h))).alias(h) for h in ("h1", "h2")])
    by_step = W.partitionBy("tree_id").orderBy("step")
    running = per_step.select(
        "tree_id",
        "step",
        (F.lead("step").over(by_step) - 1).alias("last"),
        F.sum("n").over(by_step).alias("profile_size"),
        *[F.sum(h).over(by_step).cast("decimal(38,0)").alias(name) for h, name in (("h1", "id_1"), ("h2", "id_2"))],
    )
    return first_empty_stop(running, "profile_size", ["tree_id"], "step", start=0)


def profile_identities(steps: DataFrame) -> DataFrame:
    """G5 without texts: the first and last step of every distinct profile of a tree."""
    return steps.groupBy("tree_id", "profile_size", "id_1", "id_2").agg(F.min("step").alias("step"), F.max("last").alias("last"))


def profile_members(ranges: DataFrame, descriptions: DataFrame, steps: DataFrame) -> DataFrame:
    """tree_id, step, description: a row per member of the profiles at some breakpoints (tree_id, step).

    A tree has a bounded number of breakpoints, so each node meets an array of them instead of being
    joined by range.
    """
    step_lists = steps.groupBy("tree_id").agg(F.array_sort(F.collect_set("step")).alias("_steps"))
    return (
        ranges.filter("until > after")
        .join(descriptions.select(*NODE, "description"), NODE)
        .join(step_lists, "tree_id")
        .select("tree_id", F.explode(F.expr("filter(_steps, s -> s > after AND s <= until)")).alias("step"), "description")
    )


def sweep_profiles(ranges: DataFrame, descriptions: DataFrame, max_size: int | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Profiles as lists, at every breakpoint or those of `steps`: `tree_id`, `step`, `profile_size`, `profile`.

    A list is one value, so this is for reports; `max_size` leaves out larger profiles before they are
    collected, and `profile_members` gives profiles of any size as rows.
    """
    points = sweep_breakpoints(ranges) if steps is None else steps
    if max_size is not None:
        points = points.filter(F.col("profile_size") <= max_size)
    members = profile_members(ranges, descriptions, points)
    return members.groupBy("tree_id", "step").agg(
        F.count("*").alias("profile_size"), F.array_sort(F.collect_list("description")).alias("profile")
    )


def distinct_profiles(ranges: DataFrame, descriptions: DataFrame, max_size: int | None = None) -> DataFrame:
    """Distinct profiles of each tree, numbered in the order of their joined text.

    Equal profiles are found by their ids; only the first of each is written out, up to `max_size` members.
    """
    firsts = profile_identities(profile_steps(ranges, descriptions))
    return (
        sweep_profiles(ranges, descriptions, max_size, firsts)
        .select("tree_id", "profile_size", F.array_join("profile", SEPARATOR).alias("profile"))
        .withColumn("profile_index", F.row_number().over(W.partitionBy("tree_id").orderBy("profile")) - 1)
    )


def profile_per_size(profiles: DataFrame, max_size: int) -> DataFrame:
    """For each size up to `max_size` the profile of the latest step with that size."""
    return (
        profiles.filter(F.col("profile_size") <= max_size)
        .groupBy("tree_id", "profile_size")
        .agg(F.max_by("profile", "step").alias("profile"), F.max("step").alias("step"))
    )


def persistent(flags: DataFrame, key: str = "instance_id", step: str = "step", flag: str = "extracted") -> DataFrame:
    """E5: once an instance is not extracted at a step it never counts again."""
    so_far = W.partitionBy(key).orderBy(step).rowsBetween(W.unboundedPreceding, W.currentRow)
    return flags.withColumn(flag, F.min(F.col(flag).cast("int")).over(so_far))


def extracted_until(paths: DataFrame, ranges: DataFrame) -> DataFrame:
    """Last step at which an instance located at each path lies below an extracted node.

    The ranges of the nodes on one path follow each other without a gap, so such an instance counts
    from step 0 to the largest `qualifies_until` on its way; that is also why it never comes back
    (E5). Paths on which nothing qualifies are left out.
    """
    walked = paths.select(
        "tree_id", F.col("path").alias("end_path"), F.explode(prefixes(F.col("path"), proper=True)).alias("path")
    )
    return (
        walked.join(ranges.select(*NODE, "qualifies_until"), NODE)
        .groupBy("tree_id", "end_path")
        .agg(F.max("qualifies_until").alias("last_step"))
        .withColumnRenamed("end_path", "path")
    )


def sweep_performance(
    located: DataFrame, ranges: DataFrame, results: DataFrame, direction: str = "lower", delta: float = DELTA
) -> DataFrame:
    """Number and mean result of the located instances below extracted nodes, per step.

    Instances are added up per path before anything meets the tree, then per last step; the
    cumulative sums run over at most 1 / delta rows per tree.
    """
    per_path = (
        located.join(results.select("instance_id", "result"), "instance_id")
        .groupBy(*NODE)
        .agg(F.count("*").alias("n"), F.sum("result").alias("total"))
    )
    lasts = per_path.join(extracted_until(per_path.select(*NODE), ranges), NODE)
    per_last = lasts.groupBy("tree_id", "last_step").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_step = W.partitionBy("tree_id").orderBy("last_step")
    from_here = by_step.rowsBetween(W.currentRow, W.unboundedFollowing)
    sign = -1.0 if direction == "lower" else 1.0
    starts = ranges.groupBy("tree_id").agg(F.max("extreme").alias("extreme"))
    return (
        per_last.select(
            "tree_id",
            "last_step",
            F.sum("n").over(from_here).alias("instances"),
            F.sum("total").over(from_here).alias("total"),
            (F.lag("last_step", 1, -1).over(by_step) + 1).alias("_from"),
        )
        .withColumn("step", F.explode(F.sequence("_from", "last_step")))
        .join(starts, "tree_id")
        .select(
            "tree_id",
            "step",
            (F.col("extreme") + F.lit(sign * delta) * (F.col("step") - 1)).alias("threshold"),
            "instances",
            (F.col("total") / F.col("instances")).alias("performance"),
        )
    )
