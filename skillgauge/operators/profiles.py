"""Profiles from assigned capabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window as W

from skillgauge.functions.text import score_or_default, scoring_map, seeded_hash, seeded_uniform
from skillgauge.session import cut_lineage


def explode_assignment(assignment: DataFrame, column: str = "assignment") -> DataFrame:
    """One row per instance and assigned capability number."""
    return assignment.select("instance_id", F.explode(column).alias("number"))


def assigned_results(assignment: DataFrame, capabilities: DataFrame, results: DataFrame) -> DataFrame:
    """Assigned capability, by its number in the list, with the result of the instance."""
    return (
        explode_assignment(assignment)
        .join(capabilities.select("number", "capability"), "number")
        .join(results.select("instance_id", "result"), "instance_id")
    )


def assigned_performance(assignment: DataFrame, capabilities: DataFrame, results: DataFrame) -> DataFrame:
    """Mean result per assigned capability; a capability no instance has gets no row."""
    return (
        assigned_results(assignment, capabilities, results)
        .groupBy("number", "capability")
        .agg(F.avg("result").alias("performance"), F.count("*").alias("instances"))
    )


def prior_mass(scores: DataFrame) -> DataFrame:
    """Total score per capability."""
    return scores.groupBy("capability").agg(F.sum("score").alias("mass"))


def parsed_scores(responses: DataFrame, capabilities: int, column: str = "response") -> DataFrame:
    """A score for every capability number of every response, 1 where none can be read."""
    return (
        responses.withColumn("_map", scoring_map(F.col(column)))
        .withColumn("capability", F.explode(F.sequence(F.lit(1), F.lit(capabilities))))
        .withColumn("score", score_or_default(F.col("_map"), F.col("capability").cast("string")))
        .drop("_map", column)
    )


def instances_in_order(assignment: DataFrame, capabilities: DataFrame, split: DataFrame) -> DataFrame:
    """The instances of each capability in split order, one row each.

    The rows are sorted by a range exchange, so a capability that most instances have is spread over
    many tasks instead of being collected in one.
    """
    return (
        explode_assignment(assignment)
        .join(split.select("instance_id", "position"), "instance_id")
        .join(capabilities.select("number", "capability"), "number")
        .select("capability", "position", "instance_id")
        .orderBy("capability", "position")
    )


def growing_profiles(
    performance: DataFrame, order: str, keys: Sequence[str] = (), size: int | None = None
) -> DataFrame:
    """Sort capabilities by performance, ties by list order, and emit every prefix (or one size).

    Runs over capability lists, which are short; name the columns that tell lists apart in `keys`.
    """
    ranked = W.partitionBy(*keys).orderBy("performance", order)
    so_far = ranked.rowsBetween(W.unboundedPreceding, W.currentRow)
    profiles = performance.select(
        *keys,
        F.row_number().over(ranked).alias("profile_size"),
        F.collect_list("capability").over(so_far).alias("profile"),
    )
    return profiles if size is None else profiles.filter(F.col("profile_size") == size)


# Rounds of repair after which an assignment is given up; a handful is usual.
_REPAIRS = 1000


def load_bounds(mass: Sequence[float], instances: int, picks: int = 2, tolerance: float = 0.1) -> list[tuple[int, int]]:
    """Least and most instances of each capability, whole numbers within `tolerance` of its prior share of all picks.

    Every instance may take every capability once, so an assignment exists exactly when no
    interval is empty, no load exceeds the number of instances, and all picks fit between the sums. Where that
    fails, the error names what cannot be met.
    """
    whole = sum(mass) or 1.0
    bounds = []
    for number, m in enumerate(mass, 1):
        target = picks * instances * m / whole
        least, most = math.ceil(target * (1 - tolerance) - 1e-9), min(math.floor(target * (1 + tolerance) + 1e-9), instances)
        if least > most:
            raise ValueError(f"infeasible: no load of capability {number} lies within {tolerance:.0%} of {target:.6g} and is at most {instances}")
        bounds.append((least, most))
    low, high = sum(b[0] for b in bounds), sum(b[1] for b in bounds)
    if not low <= picks * instances <= high:
        raise ValueError(f"infeasible: {picks * instances} picks, but loads add up to {low} at least and {high} at most")
    return bounds


def _wanted_loads(loads: Sequence[int], bounds: Sequence[tuple[int, int]]) -> list[int]:
    """Loads within bounds and with the same sum, as near to `loads` as that allows."""
    wanted = [min(max(load, least), most) for load, (least, most) in zip(loads, bounds)]
    gap = sum(loads) - sum(wanted)
    for j, (least, most) in enumerate(bounds):
        step = max(least - wanted[j], min(gap, most - wanted[j]))
        wanted[j] += step
        gap -= step
    return wanted


def _moves(loads: Sequence[int], wanted: Sequence[int], losses: dict[tuple[int, int], float]) -> dict[tuple[int, int], int]:
    """How many picks go from one capability to another, cheapest pairs first."""
    over = {j: load - want for j, (load, want) in enumerate(zip(loads, wanted)) if load > want}
    under = {j: want - load for j, (load, want) in enumerate(zip(loads, wanted)) if load < want}
    plan = {}
    for _, j, k in sorted((losses[j, k], j, k) for j in over for k in under if (j, k) in losses):
        n = min(over[j], under[k])
        if n:
            plan[j, k] = n
            over[j] -= n
            under[k] -= n
    return plan


def balanced_assignment(
    scores: DataFrame,
    capabilities: int,
    picks: int = 2,
    tolerance: float = 0.1,
    rounds: int = 12,
    jitter: float = 0.5,
    seed: int = 0,
) -> DataFrame:
    """Give every instance its `picks` best capabilities while loads stay within `tolerance` of their prior share.

    `scores` has `instance_id` and `scores ARRAY<DOUBLE>`, one entry per capability. Two phases:

    1. Prices. Each capability has a price and an instance takes the capabilities with the highest score minus
       price. An instance takes a capability as long as its price stays under a limit that follows from
       its other offers, so the price that gives a capability its share is a quantile of these limits. Every round moves
       all prices part of the way there: one narrow pass, a load and a quantile per capability.
    2. Repair. What is still above its bound gives picks away to what is below: exactly as many as it takes,
       those that lose least first, one pick per instance and round. Every capability is open to every
       instance, so this ends within the bounds whenever they can be met.

    Loads always end within the bounds of `load_bounds`; if these cannot be met, that is an error that says why. The
    total score is near the best, not proven best: `assignment_gap` bounds what is missing. The jitter splits instances
    with equal scores in the first phase.
    """
    offers, _, _ = _priced_offers(scores, capabilities, picks, tolerance, rounds, jitter, seed)
    return offers.select("instance_id", "scores", "assignment")


def assignment_gap(scores: DataFrame, capabilities: int, picks: int = 2, tolerance: float = 0.1, **options) -> DataFrame:
    """Total score of `balanced_assignment`, an upper bound on that of any assignment within the loads, and the gap as a share.

    The bound is the dual value of the final prices: each instance takes its best offers at the prices, and
    each load is worth its price at the end of its interval that costs most.
    """
    assigned, prices, bounds = _priced_offers(scores, capabilities, picks, tolerance, **options)
    listed = F.array(*[F.lit(float(price)) for price in prices])
    net = F.sort_array(F.zip_with("scores", listed, lambda score, price: score - price), asc=False)
    total = lambda column: F.aggregate(column, F.lit(0.0), lambda t, x: t + x)
    value = total(F.transform("assignment", lambda number: F.get("scores", number - 1).cast("double")))
    loads = sum(max(price * least, price * most) for price, (least, most) in zip(prices, bounds))
    sums = assigned.agg(F.sum(value).alias("value"), (F.sum(total(F.slice(net, 1, picks))) + F.lit(float(loads))).alias("bound"))
    return sums.withColumn("gap", (F.col("bound") - F.col("value")) / F.col("bound"))


def _priced_offers(
    scores: DataFrame, capabilities: int, picks: int, tolerance: float, rounds: int = 12, jitter: float = 0.5, seed: int = 0
) -> tuple[DataFrame, list[float], list[tuple[int, int]]]:
    jittered = F.transform(
        "scores", lambda score, i: score.cast("double") + F.lit(jitter) * seeded_uniform(seed, F.col("instance_id"), i)
    )
    table = cut_lineage(scores.select("instance_id", "scores", jittered.alias("_offer")))
    sums = table.agg(
        F.count("*").alias("n"), *[F.sum(F.get("scores", F.lit(i))).alias(f"s{i}") for i in range(capabilities)]
    ).first()
    mass = [float(sums[f"s{i}"] or 0.0) for i in range(capabilities)]
    bounds = load_bounds(mass, sums["n"], picks, tolerance)
    share = [picks * m / (sum(mass) or 1.0) for m in mass]

    def priced(prices: Sequence[float]) -> DataFrame:
        listed = F.array(*[F.lit(float(price)) for price in prices])
        net = F.zip_with("_offer", listed, lambda offer, price: offer - price)
        ranked = F.sort_array(
            F.transform(net, lambda value, i: F.struct(value.alias("net"), (-i).alias("order"))), asc=False
        )
        return table.withColumn("_ranked", ranked).withColumn(
            "assignment",
            F.array_sort(F.transform(F.slice("_ranked", 1, picks), lambda entry: (1 - entry["order"]).cast("int"))),
        )

    def limit(i: int):
        """Price below which the instance takes capability i."""
        inside = F.array_contains("assignment", i + 1)
        rival = F.when(inside, F.get("_ranked", F.lit(picks))["net"]).otherwise(F.get("_ranked", F.lit(picks - 1))["net"])
        return F.get("_offer", F.lit(i)) - rival

    prices = [0.0] * capabilities
    best_prices, least = list(prices), math.inf
    for turn in range(rounds if sums["n"] and capabilities > picks else 0):
        found = priced(prices).agg(
            *[F.count_if(F.array_contains("assignment", i + 1)).alias(f"load{i}") for i in range(capabilities)],
            *[
                F.percentile_approx(limit(i), F.lit(min(1.0, max(0.0, 1.0 - share[i]))), F.lit(1_000)).alias(f"price{i}")
                for i in range(capabilities)
            ],
        ).first()
        excess = sum(max(found[f"load{i}"] - most, low - found[f"load{i}"], 0) for i, (low, most) in enumerate(bounds))
        if excess < least:
            best_prices, least = list(prices), excess
        if not excess:
            break
        pace = 0.5 / (1.0 + 0.05 * turn)
        prices = [p + pace * (found[f"price{i}"] - p) for i, p in enumerate(prices)]
    assigned = cut_lineage(priced(best_prices).select("instance_id", "scores", "assignment"))
    return _repaired(assigned, capabilities, bounds, seed), best_prices, bounds


def _repaired(assigned: DataFrame, capabilities: int, bounds: Sequence[tuple[int, int]], seed: int) -> DataFrame:
    """`assigned` with loads within `bounds`, by moving picks that lose least."""
    for _ in range(_REPAIRS):
        counted = assigned.agg(*[F.count_if(F.array_contains("assignment", i + 1)).alias(f"load{i}") for i in range(capabilities)]).first()
        loads = [counted[f"load{i}"] for i in range(capabilities)]
        wanted = _wanted_loads(loads, bounds)
        over = [j + 1 for j, (load, want) in enumerate(zip(loads, wanted)) if load > want]
        under = [k + 1 for k, (load, want) in enumerate(zip(loads, wanted)) if load < want]
        if not over:
            return assigned
        listed = lambda numbers: F.array(*[F.lit(number) for number in numbers])

        def swapped(to: Sequence[int]) -> DataFrame:
            given = assigned.select("instance_id", "scores", F.explode(F.array_intersect("assignment", listed(over))).alias("from"), "assignment")
            return given.select("*", F.explode(F.array_except(listed(to), "assignment")).alias("to")).withColumn(
                "loss", (F.get("scores", F.col("from") - 1) - F.get("scores", F.col("to") - 1)).cast("double")
            )

        swaps = swapped(under)
        losses = {(r["from"] - 1, r["to"] - 1): r["loss"] for r in swaps.groupBy("from", "to").agg(F.avg("loss").alias("loss")).collect()}
        # Where nobody who has one of `over` lacks one of `under`, a pick makes room by way of a third capability.
        plan = _moves(loads, wanted, losses) or {(over[0] - 1, by - 1): 1 for by in range(1, capabilities + 1) if by not in over}
        if not losses:
            under = [by for by in range(1, capabilities + 1) if by not in over]
            swaps = swapped(under)
        quota = assigned.sparkSession.createDataFrame([(j + 1, k + 1, n) for (j, k), n in plan.items()], "from int, to int, quota int")
        # One move an instance: its cheapest. Then as many of each kind as are wanted, the cheapest first.
        order = [F.col("loss"), seeded_hash(seed, F.col("instance_id")), F.col("instance_id")]
        own = swaps.join(F.broadcast(quota), ["from", "to"]).groupBy("instance_id").agg(F.min(F.struct("loss", "from", "to", "quota")).alias("swap"))
        ranked = own.select("instance_id", "swap.*").withColumn("place", F.row_number().over(W.partitionBy("from", "to").orderBy(*order)))
        chosen = ranked.filter(F.col("place") <= F.col("quota")).select("instance_id", "from", "to")
        moved = F.array_sort(F.transform("assignment", lambda number: F.when(number == F.col("from"), F.col("to")).otherwise(number)))
        joined = assigned.join(chosen, "instance_id", "left")
        assigned = cut_lineage(joined.select("instance_id", "scores", F.when(F.col("from").isNull(), F.col("assignment")).otherwise(moved).alias("assignment")))
    raise RuntimeError(f"loads are not within their bounds after {_REPAIRS} rounds of repair")


def assignment_report(assigned: DataFrame) -> DataFrame:
    """Per capability the load, the prior share times all picks, and the score collected."""
    exploded = assigned.select("scores", F.explode("assignment").alias("number")).groupBy("number").agg(
        F.count("*").alias("load"), F.sum(F.get("scores", F.col("number") - 1)).alias("score")
    )
    mass = assigned.select(F.posexplode("scores").alias("position", "score")).groupBy(
        (F.col("position") + 1).alias("number")
    ).agg(F.sum("score").alias("mass"))
    totals = assigned.agg(
        F.struct(
            F.sum(F.size("assignment")).alias("picks"),
            F.sum(F.aggregate("scores", F.lit(0.0), lambda total, x: total + x)).alias("mass"),
        )
    ).scalar()
    return (
        mass.join(exploded, "number", "left")
        .fillna(0, ["load", "score"])
        .withColumn("_totals", totals)
        .select("number", "load", "score", (F.col("_totals.picks") * F.col("mass") / F.col("_totals.mass")).alias("target"))
    )
