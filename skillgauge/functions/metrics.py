"""Metric functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skillgauge.functions.text import seeded_uniform

# Labels that count as annotated.
LABELS = ["YES", "NO"]


def round3(value: Column) -> Column:
    """H8: three places, half to even."""
    return F.bround(value, 3)


def preference_wins(first: Column, second: Column) -> Column:
    """How often the first model is preferred over two presentation orders (1 = preferred)."""
    return (first == 1).cast("int") + (second == 1).cast("int")


def preference_rate(first: Column, second: Column) -> Column:
    """H6: a preference pair as 0, 0.5 or 1."""
    return preference_wins(first, second) / F.lit(2.0)


def success_ratio(wins: Column, trials: Column, empty: float = 1.0) -> Column:
    """Aggregated wins over trials; an empty set counts as `empty`."""
    return F.coalesce(F.try_divide(F.sum(wins).cast("double"), F.sum(trials).cast("double")), F.lit(empty))


def significant(lo: Column, hi: Column, threshold: Column | float, direction: str = "lower") -> Column:
    """H7: the whole interval lies strictly below (`lower`) or above (`higher`) the threshold."""
    bound = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if direction == "lower":
        return hi < bound
    if direction == "higher":
        return lo > bound
    raise ValueError(f"direction must be 'lower' or 'higher', not {direction!r}")


def attacked_probability(base: float, decay: float, planted: Column) -> Column:
    """Success probability after `planted` weaknesses."""
    return F.lit(float(base)) * F.pow(F.lit(float(decay)), planted)


def draw(probability: Column, seed: int, key: Column, turn: int = 0) -> Column:
    """Seeded 0/1 draw."""
    return (seeded_uniform(seed, key, F.lit(turn)) < probability).cast("int")


def is_label(label: Column) -> Column:
    """A usable annotation; null and free text are not."""
    return F.coalesce(label.isin(LABELS), F.lit(False))
