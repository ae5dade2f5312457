"""Model ratings from pairwise battles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from skillgauge.session import BROADCAST_ROWS, cut_lineage, written

# Winner labels that count as a tie; rating scale.
TIES = ["tie", "tie (bothbad)"]
SCALE, BASE, INITIAL = 400.0, 10.0, 1000.0
WIN_WEIGHT, TIE_WEIGHT = 2, 1
# Decimals to which ratings settle, and the rounds after which a fit that has not is an error.
DIGITS = 3
ROUNDS = 1000
# Ordered pairs of the largest group of models that one task rates: a few MB.
TASK_PAIRS = 100_000


def pairwise_wins(battles: DataFrame) -> DataFrame:
    """Weight of `model_a` over `model_b` for every ordered pair: 2 per win, 1 per tie.

    A pair counts only where each model has been seen on the sides that the three tallies (a wins,
    b wins read backwards, ties both ways) need; without any tie the tie tally asks for nothing.
    """
    kind = F.when(F.col("winner").isin(TIES), "tie").otherwise(F.col("winner"))
    tallies = (
        battles.groupBy("model_a", "model_b", kind.alias("kind"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("kind").isin("model_a", "model_b", "tie"))
    )
    weighted = tallies.select(
        F.inline(
            F.when(
                F.col("kind") == "tie",
                F.array(
                    F.struct("model_a", "model_b", (F.col("n") * TIE_WEIGHT).alias("weight")),
                    F.struct(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), (F.col("n") * TIE_WEIGHT).alias("weight")),
                ),
            )
            .when(F.col("kind") == "model_a", F.array(F.struct("model_a", "model_b", (F.col("n") * WIN_WEIGHT).alias("weight"))))
            .otherwise(
                F.array(F.struct(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), (F.col("n") * WIN_WEIGHT).alias("weight")))
            )
        )
    ).groupBy("model_a", "model_b").agg(F.sum("weight").alias("weight"))

    sides = tallies.select(
        "kind",
        F.inline(F.array(F.struct(F.col("model_a").alias("model"), F.lit("a").alias("side")), F.struct(F.col("model_b").alias("model"), F.lit("b").alias("side")))),
    )
    any_tie = F.max(F.max(F.when(F.col("kind") == "tie", 1).otherwise(0))).over(W.partitionBy())

    def seen(kind_: str, side: str):
        return F.max(F.when((F.col("kind") == kind_) & (F.col("side") == side), 1).otherwise(0))

    # One row per model.
    presence = sides.groupBy("model").agg(
        F.least(seen("model_a", "a"), seen("model_b", "b")).alias("as_row"),
        F.least(seen("model_a", "b"), seen("model_b", "a")).alias("as_column"),
        F.least(seen("tie", "a"), seen("tie", "b")).alias("in_ties"),
        any_tie.alias("any_tie"),
    ).withColumn("tied", (F.col("any_tie") == 0) | (F.col("in_ties") == 1))
    rows = presence.filter("as_row = 1 AND tied").select(F.col("model").alias("model_a"))
    columns = presence.filter("as_column = 1 AND tied").select(F.col("model").alias("model_b"))
    return weighted.join(rows, "model_a", "left_semi").join(columns, "model_b", "left_semi").select("model_a", "model_b", "weight")


def comparable_groups(wins: DataFrame) -> DataFrame:
    """model, group: the smallest model that a chain of battles leads to. Ratings compare within a group only.

    Every model takes the smallest name among its neighbours and then, by doubling, the name that one has taken.
    """
    edges = cut_lineage(wins.select(F.inline(F.array(F.struct("model_a", "model_b"), F.struct(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"))))).distinct())
    groups = cut_lineage(edges.groupBy("model_a").agg(F.least(F.first("model_a"), F.min("model_b")).alias("group")).withColumnRenamed("model_a", "model"))
    while True:
        named = edges.join(groups.select(F.col("model").alias("model_b"), "group"), "model_b")
        lowest = named.groupBy(F.col("model_a").alias("model")).agg(F.min("group").alias("lowest"))
        near = groups.join(lowest, "model").select("model", "group", F.least("group", "lowest").alias("next"))
        onward = groups.select(F.col("model").alias("next"), F.col("group").alias("beyond"))
        moved = cut_lineage(near.join(onward, "next").select("model", F.least("next", "beyond").alias("next"), "group"))
        if not moved.filter("next <> group").limit(1).count():
            return groups
        groups = moved.select("model", F.col("next").alias("group"))


def _improved(pairs: DataFrame, strengths: DataFrame, few: bool) -> DataFrame:
    """One minorise-maximise step on the log strengths `s`.

    A model's strength becomes its wins over the sum, over its opponents, of battles per joint strength. Such a step never
    lowers the likelihood.
    """
    seen = F.broadcast(strengths) if few else strengths
    own = seen.select(F.col("model").alias("model_a"), F.col("s").alias("s_a"))
    other = seen.select(F.col("model").alias("model_b"), F.col("s").alias("s_b"))
    # n / (p + q) in logarithms, so that no strength overflows.
    part = F.col("n") / (1 + F.exp(F.col("s_b") - F.col("s_a")))
    shares = pairs.join(own, "model_a").join(other, "model_b").groupBy(F.col("model_a").alias("model")).agg(F.sum(part).alias("expected"))
    return shares.join(strengths, "model").select("model", "group", "won", (F.col("s") + F.ln(F.col("won") / F.col("expected"))).alias("s"))


class _Pace:
    """How far to go along two steps, and when to stop: the same for pairs in tables and in a task."""

    def __init__(self, digits: int) -> None:
        self.enough = 0.5 * 10.0**-digits * math.log(BASE) / SCALE
        self.before = math.inf

    def length(self, r: float, v: float) -> float:
        """The extrapolation; one that made things worse is followed by plain steps."""
        length = max(1.0, r / v) if v and r <= self.before else 1.0
        self.before = r
        return length

    def done(self, first: float, second: float) -> bool:
        """Whether what the steps leave, shrinking on as they did, is small enough; both are largest shifts."""
        shrink = min(second / first, 0.9999) if first else 0.0
        return second / (1 - shrink) <= self.enough


def _solved(digits: int, rounds: int):
    """Log strengths of one group from its pairs: model_a, model_b, n, won (of model_a)."""

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        names = pc.unique(table.column("model_a"))
        i, j = (pc.index_in(table.column(c), names).to_numpy() for c in ("model_a", "model_b"))
        n, won = table.column("n").to_numpy().astype(float), np.zeros(len(names))
        won[i] = table.column("won").to_numpy()

        def step(s: np.ndarray) -> np.ndarray:
            s = s + np.log(won / np.bincount(i, n / (1 + np.exp(s[j] - s[i])), len(names)))
            return s - s.mean()

        s, pace = np.zeros(len(names)), _Pace(digits)
        for _ in range(rounds):
            one = step(s)
            two = step(one)
            r, v = one - s, two - 2 * one + s
            if pace.done(float(np.abs(r).max()), float(np.abs(two - one).max())):
                return pa.table({"model": names, "group": pa.array([key[0].as_py()] * len(names)), "s": two})
            length = pace.length(float(np.sqrt((r * r).sum())), float(np.sqrt((v * v).sum())))
            s = s + 2 * length * r + length**2 * v
        raise RuntimeError(f"ratings have not settled after {rounds} rounds")

    return solve


def _settled(pairs: DataFrame, strengths: DataFrame, digits: int, rounds: int) -> DataFrame:
    """Log strengths by steps over whole tables."""
    few = strengths.count() <= BROADCAST_ROWS
    pace, of_group = _Pace(digits), W.partitionBy("group")
    for _ in range(rounds):
        one = written(_improved(pairs, strengths, few), "one")
        two = _improved(pairs, one, few)
        steps = strengths.join(one.select("model", F.col("s").alias("s1")), "model").join(two.select("model", F.col("s").alias("s2")), "model")
        centred = steps.select("model", "group", "won", *[(F.col(c) - F.avg(c).over(of_group)).alias(c) for c in ("s", "s1", "s2")])
        steps = written(centred.withColumns({"r": F.col("s1") - F.col("s"), "v": F.col("s2") - 2 * F.col("s1") + F.col("s")}), "steps")
        norm = lambda c: F.sqrt(F.sum(F.col(c) ** 2))
        r, v, first, second = steps.agg(norm("r"), norm("v"), F.max(F.abs("r")), F.max(F.abs(F.col("s2") - F.col("s1")))).first()
        if pace.done(first, second):
            return steps.select("model", "group", F.col("s2").alias("s"))
        length = pace.length(r, v)
        strengths = steps.select("model", "group", "won", (F.col("s") + 2 * length * F.col("r") + length**2 * F.col("v")).alias("s"))
    raise RuntimeError(f"ratings have not settled after {rounds} rounds")


def bradley_terry(
    wins: DataFrame, anchor: tuple[str, float] | None = None, rounds: int = ROUNDS, digits: int = DIGITS, task_pairs: int = TASK_PAIRS
) -> DataFrame:
    """Maximum-likelihood ratings, `SCALE * strength + INITIAL`, optionally shifted so that the
    anchor model has a given rating.

    `wins` is D19's table, one row per ordered pair of models. Neither models nor pairs are bounded: a step joins
    strengths to the pairs and adds up per model. Two steps and an extrapolation along their difference make a round;
    rounds end when no rating would still move by half a unit of the last of `digits` decimals. Groups of connected
    models with up to `task_pairs` pairs take the same rounds inside one task each.

    Only differences within a group are determined, so each group is centred on the initial rating and only the
    anchor's group is shifted. A model that has only won or only lost has no finite rating, which is an error,
    as is a fit that is open after `rounds` rounds.
    """
    weighted = cut_lineage(wins.filter("model_a <> model_b AND weight > 0").groupBy("model_a", "model_b").agg(F.sum("weight").alias("weight")))
    both = weighted.unionByName(weighted.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), "weight"))
    won = weighted.groupBy(F.col("model_a").alias("model")).agg(F.sum("weight").cast("double").alias("won"))
    lost = weighted.groupBy(F.col("model_b").alias("model")).agg(F.lit(True).alias("lost"))
    models = cut_lineage(comparable_groups(weighted).join(won, "model", "left").join(lost, "model", "left"))
    odd = [r["model"] for r in models.filter("won IS NULL OR lost IS NULL").orderBy("model").limit(5).collect()]
    if odd:
        raise ValueError(f"no finite rating for models that never lost or never won: {', '.join(odd)}")
    facts = models.select(F.col("model").alias("model_a"), "group", "won")
    pairs = both.groupBy("model_a", "model_b").agg(F.sum("weight").alias("n")).join(facts, "model_a")
    counted = pairs.groupBy("group").agg((F.count("*") <= task_pairs).alias("small"))
    pairs = cut_lineage(pairs.join(counted, "group"))
    strengths = pairs.filter("small").groupBy("group").applyInArrow(_solved(digits, rounds), "model string, group string, s double")
    large = pairs.filter("NOT small")
    if not large.isEmpty():
        start = cut_lineage(models.join(counted.filter("NOT small"), "group").select("model", "group", "won", F.lit(0.0).alias("s")))
        strengths = strengths.unionByName(_settled(large.select("model_a", "model_b", "n"), start, digits, rounds))
    rated = strengths.select("model", "group", (F.col("s") / math.log(BASE) * SCALE + INITIAL).alias("rating"))
    if anchor is not None:
        rated = cut_lineage(rated)
        fixed = rated.filter(F.col("model") == anchor[0]).select("group", (F.lit(float(anchor[1])) - F.col("rating")).alias("shift"))
        rated = rated.join(F.broadcast(fixed), "group", "left").withColumn("rating", F.col("rating") + F.coalesce("shift", F.lit(0.0)))
    return rated.select("model", "rating")


def rating_table(ratings: DataFrame) -> DataFrame:
    """models from the highest rating down, with their rank. One row per model."""
    ranked = W.orderBy(F.desc("rating"), "model")
    return ratings.select("model", "rating", F.row_number().over(ranked).alias("rank")).orderBy("rank")
