"""Planning of a run from a few numbers (inventory ids E8-E10); scalars on the driver, no tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Least word size that is chosen, and greatest share of a row's length; reach beyond which a limit isn't worth while.
LEAST_WORD, MOST_SHARE, FAR_REACH = 49, 0.75, 6000
#: Share of base coverage that word coverage should have, and its bound; chance that a target has a position no word covers.
SHARE, MOST_COVERAGE, BROKEN = 0.35, 60.0, 0.01


def rows_needed(measure: Callable[[int], tuple[float, float]], first: int, cap: int, totals: list[int], target: float, growth: int = 5, enough: float = 5.0, worth: float = 0.1) -> list[int]:
    """Rows to take from each of several files for a coverage of about ``target``.

    measure(n) takes the first n rows and tells (least coverage of the targets, share of the
    data seen). n grows until the coverage is enough, or until more than ``worth`` of the data
    has been seen; then the coverage of the whole is extrapolated, and where it is above
    the target every file is cut down by one ratio, under the cap.
    """
    n = first
    while True:
        coverage, seen = measure(n)
        if coverage >= enough or seen > worth or seen >= 1:
            break
        n *= growth
    whole = coverage / seen if coverage >= enough and seen > 0 else 0.0
    if whole <= target:
        return [cap] * len(totals)
    return [min(cap, math.ceil(t * target / whole)) for t in totals]


def unbroken_coverage(size: int, broken: float = BROKEN, least: float = 5.0, step: float = 0.05) -> float:
    """The least word coverage, from ``least`` on in steps, at which a target of that size is covered whole but for the chance ``broken``.

    A position isn't covered with chance exp(-c); all of them are with (1 - exp(-c))**size.
    """
    exact = -math.log(-math.expm1(math.log1p(-broken) / size))
    return least + step * max(0, math.ceil((exact - least) / step - 1e-9))


def wrong_share(length: int, error: float) -> float:
    """Share of words that errors make wrong: with k errors in a row, 1 - 2**-k of its words (binomial, up to ten times the mean)."""
    most = int(min(length * error * 10, length))
    if error <= 0 or most <= 1:
        return 0.0
    k = np.arange(1, most)
    log_choose = np.array([math.lgamma(length + 1) - math.lgamma(i + 1) - math.lgamma(length - i + 1) for i in k])
    return float(((1 - 0.5**k) * np.exp(log_choose + k * math.log(error) + (length - k) * math.log1p(-error))).sum())


def corrected_coverage(words: float, bases: float, error: float, length: int) -> float:
    """Word coverage raised for what errors take away; what goes beyond half the base coverage counts to the power 0.34."""
    if error == 0:
        return words
    raised = words / (1 - wrong_share(length, error))
    half = 0.5 * bases
    if words > half:
        return words + (raised - words) ** 0.34
    return half + (raised - half) ** 0.34 if raised > half else raised


def word_size(coverage: float, length: float, size: int, error: float = 0.015, least: int = LEAST_WORD, share: float = SHARE, most_coverage: float = MOST_COVERAGE, broken: float = BROKEN) -> int:
    """Word size for rows of a mean length that cover a target of that size so many times.

    Words should cover the target by a share of the base coverage, bounded above, and at
    least so much that it is unlikely to break, as far as the shortest words can; corrected
    for errors, half of which count. Word coverage is base coverage times (length - w + 1) / length.
    """
    if coverage <= 0:
        raise ValueError("no coverage: the seeds don't fit or there are too few rows")
    floor = min(unbroken_coverage(size, broken), coverage * (1 - (least - 1) / length))
    wanted = corrected_coverage(max(floor, min(most_coverage, coverage * share)), coverage, error / 2, int(length))
    return min(int(length * MOST_SHARE), max(least, int(length * (1 - wanted / coverage)) + 1))


def word_size_of_ratio(ratio: float, length: float, least: int = 29) -> int:
    """A word size given as a share of the mean length if below 1, else as it is, within bounds."""
    return max(least, round(ratio * length)) if ratio < 1 else min(int(ratio), round(length * 0.9))


@dataclass(frozen=True)
class Measured:
    """What is known of one target: coverage with a deviation each way, its size, the best reference's length, share and longest run without coverage."""

    coverage: float
    low: float
    high: float
    size: int
    reference: int
    gap_share: float
    gaps: tuple[int, ...]


def reach(target: Measured, longest: int, gathered: int | None = None) -> float:
    """How far rows may lie from a seed: half of the longest gap, more where much is missing or the coverage varies, in hundreds.

    Unlimited where the reference is short for the target, or more than 0.4 of it is missing.
    ``gathered``: the word size that rows were gathered with before, which may have closed gaps.
    """
    if target.reference < target.size / 10 or target.gap_share > 0.4:
        return math.inf
    spread = (target.high - target.low) / 2 / target.coverage
    out = target.gaps[0] / 2 * (1 + target.gap_share**0.5) * (1 + spread**0.5) if target.gaps else 1.0
    out += 2 * (longest - gathered) if gathered is not None else 0
    return math.ceil(out / 100) * 100


def resolve_parameters(targets: list[Measured], rows: list[int], mean: float, longest: int, error: float = 0.015, limit: float = 500.0, word: float | None = None, larger: bool = False, least: int = LEAST_WORD, gathered: int | None = None) -> dict:
    """One set of parameters for several targets.

    Where even the least covered target is above the limit, all rows and coverages are cut
    by one ratio. The word size is the least over the targets (larger: sizes from 69 on, a
    share less by 0.03, chance 0.05), or the given one. Reaches are those of reach, all
    unlimited if none is below 6000. divergent: coverages differ by more than a factor of ten.
    """
    ratio = min(1.0, limit / min(t.coverage for t in targets))
    covered = [t.coverage * ratio for t in targets]
    how = {"least": 69, "share": SHARE - 0.03, "broken": 0.05} if larger else {"least": least}
    sizes = [word_size(c, mean, t.size, error, **how) for c, t in zip(covered, targets)] if word is None else [word_size_of_ratio(word, mean)]
    reaches = [reach(t, longest, gathered) for t in targets]
    whole = all(r >= FAR_REACH for r in reaches)
    return {
        "word_size": min(sizes), "word_sizes": sizes, "rows": [int(n * ratio) if ratio < 1 else n for n in rows], "coverage": covered,
        "max_extend": [math.inf] * len(targets) if whole else reaches, "keep_parts": min(sizes) / longest <= 0.5,
        "divergent": max(t.coverage for t in targets) > 10 * min(t.coverage for t in targets),
    }
