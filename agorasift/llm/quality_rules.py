"""Quality rules: decision lists learned by sequential covering."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from agorasift.llm.textstats import labelled_sample, ratios, text_counts

SAMPLE = 20_000  # labelled rows that the list is learned from, at most


@dataclass(frozen=True)
class Condition:
    """A statistic at most, or above, a threshold."""

    name: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, statistics: Mapping[str, Column]) -> Column:
        value, at = statistics[self.name], F.lit(self.threshold)
        return value > at if self.above else value <= at


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are dropped."""

    conditions: tuple[Condition, ...]

    def covers(self, values: Mapping[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(values[c.name]) for c in self.conditions])


def _worth(positive: float, negative: float) -> float:
    """Laplace estimate of a rule's precision."""
    return (positive + 1) / (positive + negative + 2)


def _best_condition(values, bad, inside, thresholds):
    """The condition with the largest information gain over the rows inside."""
    p0, n0 = float((inside & bad).sum()), float((inside & ~bad).sum())
    before, best = np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)), (0.0, None)
    for name, cuts in thresholds.items():
        if not len(cuts):
            continue
        at = np.searchsorted(cuts, values[name][inside], side="left")
        low_p = np.cumsum(np.bincount(at[bad[inside]], minlength=len(cuts) + 1))[:-1].astype(float)
        low_n = np.cumsum(np.bincount(at[~bad[inside]], minlength=len(cuts) + 1))[:-1].astype(float)
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - before)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), Condition(name, above, float(cuts[k])))
    return best[1] and replace(best[1], threshold=_half_way(values[best[1].name][inside], best[1].threshold))


def _half_way(values: np.ndarray, cut: float) -> float:
    """The cut, moved to the middle of the gap between the values that it parts."""
    return float((values[values <= cut].max(initial=-np.inf) + values[values > cut].min(initial=np.inf)) / 2) if (values > cut).any() and (values <= cut).any() else cut


def learn(
    values: Mapping[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4,
    precision: float = 0.9, least: int = 5, cuts: int = 64,
) -> list[Rule]:
    """An ordered list of rules for bad rows; what no rule covers is kept.

    Each rule is grown on two thirds of the rows that are left, a condition at
    a time by information gain, then conditions are pruned from its end while
    the last third values that.  Rows it covers are set aside.  Learning ends
    with a rule that covers fewer than ``least`` bad rows or is right less
    often than ``precision``.
    """
    bad = bad.astype(bool)
    thresholds = {n: np.unique(np.quantile(v, np.arange(1, cuts) / cuts)) if len(v) else v for n, v in values.items()}
    left, grow = np.ones(len(bad), bool), np.arange(len(bad)) % 3 != 2
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & bad).any():
        inside, conditions = left & grow, []
        while len(conditions) < most_conditions and (inside & ~bad).any():
            found = _best_condition(values, bad, inside, thresholds)
            if found is None:
                break
            conditions.append(found)
            inside = inside & found.holds(values[found.name])
        test = left & ~grow

        def value(size: int) -> float:
            covered = test & Rule(tuple(conditions[:size])).covers(values)
            return _worth((covered & bad).sum(), (covered & ~bad).sum())

        if not conditions:
            break
        size = max(range(1, len(conditions) + 1), key=lambda s: (value(s), -s))
        rule = Rule(tuple(conditions[:size]))
        covered = left & rule.covers(values)
        right = int((covered & bad).sum())
        if right < least or right < precision * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule], statistics: Mapping[str, Column]) -> Column:
    """True where no rule drops the row: one ordered conditional expression."""
    tests = [reduce(lambda a, b: a & b, [c.column(statistics) for c in r.conditions]) for r in rules]
    chain = reduce(lambda so_far, t: F.when(t, False) if so_far is None else so_far.when(t, False), tests, None)
    return F.lit(True) if chain is None else chain.otherwise(True)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``most`` labelled rows outside the held-out fold; label 0 is bad."""
    sample = text_counts(labelled_sample(docs, labels, label, most), ["doc_id", "label"])
    rows = sample.select("label", *[e.cast("double").alias(n) for n, e in ratios().items()]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    values = {n: np.array([r[n] for r in rows], float) for n in ratios()}
    return learn(values, np.array([r["label"] for r in rows], float) == 0)


def judge(docs: DataFrame, rules: list[Rule], least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, one row per row of ``docs``.

    A text fails the base with fewer than ``least_words`` words, or with more
    than ``most_repeated`` in a hundred words inside repeated windows; others
    are kept unless a rule of the list drops them.  Defined cases: null and
    empty texts have no words and fail; repeated rows are judged alike; other
    columns are not read; an empty table gives an empty table; an empty list
    keeps what passes the base.  No shuffle.
    """
    counted = text_counts(docs, ["doc_id"])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & verdict(rules, ratios())).alias("kept"))
