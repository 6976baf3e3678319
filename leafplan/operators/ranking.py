"""Scoring and ranking of candidate page outlines.

A candidate row has: image_id, candidate_id, source, mask_quad_iou,
mask_coverage, edge_support, geometry_quality, border_contact (null: not
reported), has_overlap, enclosed_length, enclosed_ridges, aligns, perimeter,
aspect_ratio, and, if it is known, convex. One window by image ranks them;
nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafplan.functions.geometry import rounded, unit

# The component weights and source reliabilities of the scoring policy.
WEIGHTS = {"mask_iou": 0.4, "mask_coverage": 0.05, "mask_confidence": 0.1, "edge_support": 0.1, "geometry": 0.15, "convexity": 0.05, "border": 0.05, "aspect": 0.05, "source_reliability": 0.1}
RELIABILITY = {"mask_fit": 0.95, "mixed": 0.9, "contour": 0.65, "hough": 0.6}


@dataclass(frozen=True)
class ScoringPolicy:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    reliability: Mapping[str, float] = field(default_factory=lambda: dict(RELIABILITY))
    neutral_mask: float = 0.5
    neutral_edge: float = 0.5
    neutral_aspect: float = 0.5
    border_touch: float = 0.8
    minimum_score: float = 0.55
    margin: float = 0.03
    occlusion_weight: float = 0.25
    alignment_bonus: float = 0.08
    length_scale: float = 0.25
    mask_confidence: float | None = None
    aspect_hint: float | None = None

    def __post_init__(self) -> None:
        if sum(self.weights.values()) <= 0 or any(not 0 <= v <= 1 for v in [*self.weights.values(), *self.reliability.values()]):
            raise ValueError("weights and reliabilities must lie in [0, 1], and a weight must be positive")

    @property
    def total(self) -> float:
        """The sum of the weights, added as decimals."""
        return float(sum(map(_decimal, self.weights.values())))


def _decimal(x: float) -> Decimal:
    return Decimal(str(x))


@dataclass(frozen=True)
class Part:
    """A component of a score: its value, and the neutral one where there is none.

    One that takes only a few values has them in ``fixed``, each with its
    condition; where none holds, the neutral one.
    """

    value: Column
    neutral: float
    policy: str
    missing: str | None = None
    fixed: tuple[tuple[Column, float], ...] = ()

    @property
    def known(self) -> Column:
        return F.coalesce(self.value, F.lit(self.neutral))

    def weighted(self, weight: float) -> Column:
        """The known value times ``weight``; two constants are multiplied as decimals, as in SQL: 0.05 times 0.8 is 0.04."""
        if not self.fixed:
            return self.known * weight
        product = lambda x: F.lit(float(_decimal(weight) * _decimal(x)))
        out = product(self.neutral)
        for condition, value in reversed(self.fixed):
            out = F.when(condition, product(value)).otherwise(out)
        return out


def _clipped(name: str) -> Column:
    """A column between 0 and 1, null where it is null."""
    return F.when(F.col(name).isNotNull(), unit(F.col(name).cast("double")))


def components(policy: ScoringPolicy, columns: list[str]) -> dict[str, Part]:
    """The components of a candidate's score, of what ``columns`` it has."""
    contact = ((F.col("border_contact"), policy.border_touch), (~F.col("border_contact"), 1.0))
    trust = tuple((F.col("source") == source, value) for source, value in policy.reliability.items())
    known = F.lit(0.5)
    for condition, value in trust:
        known = F.when(condition, F.lit(value)).otherwise(known)
    hint = policy.aspect_hint
    aspect = F.lit(None).cast("double") if hint is None else unit(1.0 - F.abs(F.col("aspect_ratio") - hint) / hint)
    return {
        "mask_iou": Part(F.col("mask_quad_iou"), policy.neutral_mask, "mask_quad_iou"),
        "mask_coverage": Part(_clipped("mask_coverage"), policy.neutral_mask, "mask_coverage"),
        "mask_confidence": Part(F.lit(policy.mask_confidence).cast("double"), policy.neutral_mask, "mask_confidence"),
        "edge_support": Part(F.col("edge_support"), policy.neutral_edge, "edge_support"),
        "geometry": Part(F.col("geometry_quality"), 0.0, "geometry_gate_quality"),
        "convexity": Part(F.coalesce(_clipped("convex"), F.lit(1.0)) if "convex" in columns else F.lit(1.0), 0.0, "convexity"),
        "border": Part(F.when(*contact[0]).when(*contact[1]), 1.0, "border_touch_allowed", "border_not_reported", contact),
        "aspect": Part(aspect, policy.neutral_aspect, "soft_aspect_hint"),
        "source_reliability": Part(known, 0.5, "source_reliability", fixed=trust),
    }


def _penalty_and_bonus(policy: ScoringPolicy) -> tuple[Column, Column, Column]:
    """The share of the perimeter that ridges take, and what that and an alignment add."""
    length = F.greatest(F.coalesce("enclosed_length", F.lit(0.0)), F.lit(0.0))
    overlap = F.coalesce("has_overlap", F.lit(False))
    ratio = F.when(overlap, F.least(F.lit(1.0), length / F.greatest(F.lit(1e-6), policy.length_scale * F.col("perimeter")))).otherwise(0.0)
    bonus = F.when(overlap & F.coalesce("aligns", F.lit(False)), policy.alignment_bonus).otherwise(0.0)
    return ratio, policy.occlusion_weight * ratio, bonus


def final_score(policy: ScoringPolicy, columns: list[str]) -> Column:
    """The score of a candidate under ``policy``.

    The parts are added in order and divided by the sum of the weights once, so that the last bit is that of the SQL.
    """
    score = None
    for name, part in components(policy, columns).items():
        one = part.weighted(policy.weights[name])
        score = one if score is None else score + one
    _, penalty, bonus = _penalty_and_bonus(policy)
    return unit(score / policy.total - penalty + bonus)


def breakdown(policy: ScoringPolicy, columns: list[str]) -> Column:
    """Map of component to ``value, weight, normalized_weight, contribution, applicable, policy``."""
    total = policy.total

    def entry(value: Column, weight: float, share: float, contribution: Column, applicable: Column, text: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), F.lit(float(weight)).alias("weight"), F.lit(float(share)).alias("normalized_weight"), contribution.cast("double").alias("contribution"), applicable.alias("applicable"), text.alias("policy"))

    found = {}
    for name, part in components(policy, columns).items():
        weight, known = policy.weights[name], part.value.isNotNull()
        found[name] = entry(part.known, weight, weight / total, part.known * (weight / total), known, F.when(known, part.policy).otherwise("neutral:" + (part.missing or part.policy)))
    ratio, penalty, bonus = _penalty_and_bonus(policy)
    overlap = F.coalesce("has_overlap", F.lit(False))
    lined = overlap & F.coalesce("aligns", F.lit(False))
    found["occlusion_penalty"] = entry(ratio, policy.occlusion_weight, 0.0, -penalty, overlap, F.when(overlap, "verified_occlusion_ridge_penalty").otherwise("neutral:no_occlusion"))
    found["occlusion_alignment"] = entry(F.when(lined, 1.0).otherwise(0.0), policy.alignment_bonus, 0.0, bonus, lined, F.when(lined, "verified_occlusion_ridge_alignment").otherwise("neutral:no_occlusion"))
    return F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)])


#: One policy, or several that the column ``policy`` tells apart by name.
Policies = ScoringPolicy | Mapping[str, ScoringPolicy]


def _under(policies: Policies, of) -> Column:
    """``of(policy)`` of the policy that holds for the row."""
    if isinstance(policies, ScoringPolicy):
        return of(policies)
    out = F.lit(None)
    for name, policy in policies.items():
        out = F.when(F.col("policy") == name, of(policy)).otherwise(out)
    return out


def with_scores(candidates: DataFrame, policy: Policies | None = None, *, explain: bool = False) -> DataFrame:
    """Adds ``final_score`` and, if asked for, ``breakdown``."""
    policy = policy or ScoringPolicy()
    out = candidates.withColumn("final_score", _under(policy, lambda p: final_score(p, candidates.columns)))
    return out.withColumn("breakdown", _under(policy, lambda p: breakdown(p, candidates.columns))) if explain else out


def ranked(candidates: DataFrame, policy: Policies | None = None, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Adds ``final_score`` and ``rank``; scores equal to nine places are ties and go by coverage, geometry, source and id."""
    policy = policy or ScoringPolicy()
    coverage = F.coalesce(_clipped("mask_coverage"), _under(policy, lambda p: F.lit(p.neutral_mask)))
    order = W.partitionBy(*by).orderBy(rounded(F.col("final_score"), 9).desc(), coverage.desc(), F.desc("geometry_quality"), "source", "candidate_id")
    return with_scores(candidates, policy).withColumn("rank", F.row_number().over(order))


def decisions(candidates: DataFrame, policy: Policies | None = None, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Per image: status, the selected candidate, the two best scores and their difference.

    Within the margin of the best, in turn: the fewest enclosed ridges; the only
    aligned one; with coverages 0.08 or more apart the greatest coverage; the
    best fit if it leads by 0.005, or if its geometry leads by 0.02.
    """
    policy = policy or ScoringPolicy()
    image = W.partitionBy(*by)
    rows = ranked(candidates, policy, by).withColumn("top", F.max("final_score").over(image))
    near = rows.withColumn("near", F.col("top") - F.col("final_score") <= _under(policy, lambda p: F.lit(p.margin)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    overlap = F.coalesce("has_overlap", F.lit(False))
    near = near.withColumns({
        "cov": zero("mask_coverage"), "iou": zero("mask_quad_iou"),
        "ridges": F.when(overlap, F.greatest(F.lit(0), F.coalesce("enclosed_ridges", F.lit(0)))).otherwise(0),
        "lined": overlap & F.coalesce("aligns", F.lit(False)),
    })
    near = near.withColumn("few", F.min(F.when(F.col("near"), F.col("ridges"))).over(image))
    win = F.col("near") & (F.col("ridges") == F.col("few"))
    # Ordered triples make the best and the second best of the contenders by one sort each.
    fit = F.sort_array(F.collect_list(F.when(F.col("near"), F.struct((-F.col("iou")).alias("a"), (-F.col("geometry_quality")).alias("b"), F.col("candidate_id").alias("id")))))
    full = F.min(F.when(F.col("near"), F.struct((-F.col("cov")).alias("a"), (-F.col("geometry_quality")).alias("b"), F.col("candidate_id").alias("id"))))
    groups = near.groupBy(*by).agg(
        F.max(F.when(F.col("rank") == 1, F.col("final_score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 2, F.col("final_score"))).alias("second_score"),
        F.max(F.when(F.col("rank") == 1, F.col("candidate_id"))).alias("first_id"),
        F.count_if("near").alias("n_near"),
        F.count_if(win).alias("n_few"),
        F.max(F.when(win, F.col("candidate_id"))).alias("few_id"),
        F.count_if(win & F.col("lined")).alias("n_lined"),
        F.count_if(win & ~F.col("lined")).alias("n_unlined"),
        F.max(F.when(win & F.col("lined"), F.col("candidate_id"))).alias("lined_id"),
        (F.max(F.when(F.col("near"), F.col("cov"))) - F.min(F.when(F.col("near"), F.col("cov")))).alias("cov_gap"),
        full.alias("full"),
        F.slice(fit, 1, 2).alias("fit"),
    )
    best, next_ = F.get("fit", F.lit(0)), F.get("fit", F.lit(1))
    resolved = (
        F.when(F.col("n_few") == 1, F.col("few_id"))
        .when((F.col("n_lined") == 1) & (F.col("n_unlined") > 0), F.col("lined_id"))
        .when(F.col("cov_gap") >= 0.08, F.col("full.id"))
        .when(next_["a"] - best["a"] >= 0.005, best["id"])
        .when(next_["b"] - best["b"] >= 0.02, best["id"])
    )
    groups = groups.withColumn("resolved", resolved)
    close = F.col("second_score").isNotNull() & (F.col("top_score") - F.col("second_score") <= _under(policy, lambda p: F.lit(p.margin)))
    low = F.col("top_score") < _under(policy, lambda p: F.lit(p.minimum_score))
    status = F.when(low, "below_threshold").when(close & F.col("resolved").isNull(), "ambiguous").otherwise("selected")
    chosen = F.when(low, None).when(close, F.col("resolved")).otherwise(F.col("first_id"))
    return groups.select(*by, status.alias("status"), chosen.alias("selected_candidate_id"), "top_score", "second_score", F.bround(F.col("top_score") - F.col("second_score"), 4).alias("score_delta"))


def sweep(candidates: DataFrame, policies: Mapping[str, ScoringPolicy]) -> DataFrame:
    """Decisions under several policies, told apart by ``policy``, in one pass over the candidates."""
    each = candidates.withColumn("policy", F.explode(F.array(*map(F.lit, policies))))
    return decisions(each, policies, ("policy", "image_id"))


def top_k(rows: DataFrame, by: tuple[str, ...], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark drops the others before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def pool_score(iou: Column, coverage: Column, edge: Column, geometry: Column) -> Column:
    """The preliminary score of a candidate; a missing coverage still adds its part."""
    return unit(0.45 * geometry + 0.40 * F.coalesce(iou, F.lit(0.0)) + 0.10 * F.coalesce(edge, F.lit(0.0)) + 0.05 * F.coalesce(coverage, F.lit(1.0)))


def source_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def pick_component(components_: DataFrame, lead: float = 0.08) -> DataFrame:
    """Per image the best mask component, and whether the next one is within ``lead``.

    Columns: image_id, label, area, score.
    """
    order = W.partitionBy("image_id").orderBy(F.desc("score"), F.desc("area"), "label")
    rows = components_.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    return rows.where("rank = 1").select("image_id", "label", "score", F.coalesce(F.col("score") - F.col("next") <= lead, F.lit(False)).alias("ambiguous"))
