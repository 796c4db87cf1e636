"""Column functions on risk scores: bins, pools of several models, tiers, boosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the deployment.
FLAG, REVIEW, CONFIRMED, SOFT, WEIGHT = 0.32, 0.26, 0.42, 0.26, 0.25


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def edges(n: int) -> list[float]:
    """n + 1 edges of equal bins, i * (1.0 / n) in doubles with the last one 1; not always i / n."""
    return [i * (1.0 / n) for i in range(n)] + [1.0]


def bin_of(x: Column, n: int) -> Column:
    """Index of the bin that starts at the last edge that isn't above x; 0 to n - 1."""
    return reduce(lambda a, b: a + b, [F.when(x >= F.lit(e), 1).otherwise(0) for e in edges(n)[1:-1]])


def slot_of(x: Column, n: int) -> Column:
    """Index of the last of the steps i / n that isn't above x; 0 to n - 1."""
    k = F.floor(x * n).cast("int")
    k = k + F.when(x >= (k + 1) / F.lit(float(n)), 1).otherwise(0) - F.when(x < k / F.lit(float(n)), 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), k))


def mean(*x: Column) -> Column:
    return reduce(lambda a, b: a + b, x) / len(x)


def median(*x: Column) -> Column:
    s, n = F.array_sort(F.array(*x)), len(x)
    return F.element_at(s, n // 2 + 1) if n % 2 else (F.element_at(s, n // 2) + F.element_at(s, n // 2 + 1)) / 2


def closest_pair(*x: Column) -> Column:
    """Mean of the two scores that are nearest to each other; of equal distances, the first pair."""
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x))]
    return F.array_min(F.array(*[F.struct(F.abs(x[i] - x[j]).alias("d"), F.lit(k).alias("k"), ((x[i] + x[j]) / 2).alias("m")) for k, (i, j) in enumerate(pairs)]))["m"]


def rank_decay(scores: list[Column], trusts: list[Column]) -> Column:
    """Scores weighted 1, 1/10, 1/100, ... in falling order of trust, over the sum of weights."""
    s = F.array_sort(F.array(*[F.struct((-t).alias("t"), F.lit(i).alias("i"), x.alias("x")) for i, (x, t) in enumerate(zip(scores, trusts, strict=True))]))
    weights = [10.0**-i for i in range(len(scores))]
    return reduce(lambda a, b: a + b, [F.element_at(s, i + 1)["x"] * w for i, w in enumerate(weights)]) / sum(weights)


def tier(x: Column, flag: float = FLAG, review: float = REVIEW) -> Column:
    return F.when(x >= flag, "vuln").when(x >= review, "needs_review").otherwise("safe")


def deployment(score: Column, flag: float = FLAG, review: float = REVIEW) -> dict[str, Column]:
    """What a function's score says by itself: tier, status and the flags that follow from them."""
    x = clip(score)
    vuln, some = x >= flag, x >= review
    return {
        "deployment_tier": tier(x, flag, review),
        "agreement_status": F.when(vuln, "agree_positive").when(some, "review_suggested").otherwise("agree_negative"),
        "function_flagged": vuln, "function_needs_review": some, "user_facing_vuln": some, "whole_function_vuln": vuln,
    }


def agreement(flagged: Column, any_window: Column) -> Column:
    return F.when(flagged & any_window, "agree_positive").when(flagged, "diffuse_risk").when(any_window, "review_suggested").otherwise("agree_negative")


def precision_tier(flagged: Column, confirmed: Column) -> Column:
    """A confirmed window alone asks for investigation, a flag alone for a soft review."""
    return F.when(flagged & confirmed, "confirmed").when(confirmed, "investigate").when(flagged, "soft_review").otherwise("safe")


def user_facing(tier: Column) -> Column:
    return tier.isin("confirmed", "investigate")


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits by its exact binary value, ties to even; F.round goes by the shortest decimal text, half up."""
    return F.replace(F.format_number(x, digits), F.lit(",")).cast("double")


def smooth_boost(x: Column, alpha: float = 0.4) -> Column:
    """The score moved towards 1 by a share alpha."""
    return rounded(clip(x) + alpha * (1 - clip(x)), 6)


def plateau_boost(x: Column, confidence: Column, flag: float = FLAG) -> Column:
    """The least score that a known pattern of this confidence stands for."""
    return rounded(F.least(F.lit(1.0), F.greatest(x, F.lit(0.58), F.lit(flag + 0.26), 0.92 * confidence)), 6)


def graduated_boost(x: Column, support: Column, confidence: Column, flag: float = FLAG) -> Column:
    """The score blended towards the plateau by support and confidence."""
    plateau = plateau_boost(x, confidence, flag)
    blend = F.least(F.lit(1.0), F.least(F.lit(1.0), support / flag) * F.least(F.lit(1.0), confidence / 0.88))
    return rounded(F.least(plateau, F.greatest(x, support + 0.05, x + (plateau - x) * blend)), 6)


def corroborated(support: Column, flag: float = FLAG, slack: float = 0.15) -> Column:
    return support >= flag - slack


def category(flagged: Column, known: Column) -> Column:
    """How a flag and a known pattern go together."""
    return F.when(flagged & known, "known_signature").when(flagged, "novel_pattern").when(known, "signature_only").otherwise("no_signal")


def boosted(score: Column, top_window: Column, confidence: Column, flagged: Column, smooth: bool = True, graduated: bool = False, flag: float = FLAG, floor: float = 0.45, window_confirmed: Column | None = None) -> dict[str, Column]:
    """Boost of a function's score by a signature: mode (null where none applies), score, tier and whole_function_vuln.

    A pattern counts from a confidence of `floor`, and where the best of function and window score supports it.
    window_confirmed is the record's own threshold of confirmed windows; null or 0 means that no window is one.
    """
    kind, support = category(flagged, confidence >= floor), F.greatest(score, top_window)
    applies = kind.isin("known_signature", "signature_only") & (confidence >= floor)
    mode = F.when(~applies, None).when(~corroborated(support, flag), "blocked")
    if smooth:
        mode = mode.when(kind == "known_signature", "smooth_agreement").otherwise("smooth_signature_only")
    else:
        mode = mode.otherwise("graduated" if graduated else "plateau")
    raised = F.when(mode == "smooth_agreement", smooth_boost(score, 0.4)).when(mode == "smooth_signature_only", smooth_boost(score, 0.3)).when(mode == "graduated", graduated_boost(score, support, confidence, flag)).when(mode == "plateau", plateau_boost(score, confidence, flag))
    better = F.coalesce(raised > score + 1e-9, F.lit(False))
    new = F.when(better, raised).otherwise(score)
    least = F.coalesce(F.lit(None).cast("double") if window_confirmed is None else window_confirmed, F.lit(0.0))
    sure = better & (new >= flag) & (new >= 0.85) & ((confidence >= 0.88) | ((least > 0) & (top_window >= least)))
    return {"boost_mode": F.when(better | (mode == "blocked"), mode), "boosted_score": new, "boosted_tier": F.when(sure, "confirmed").otherwise(tier(clip(new), flag)), "whole_function_vuln": clip(new) >= flag}


def cosine(a: Column, b: Column, least_norm: float = 1e-9) -> Column:
    """Cosine of two arrays of equal length; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > least_norm, dot(a, b) / norm).otherwise(0.0)
