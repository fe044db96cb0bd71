"""One ranking from several differently-scaled scores, by distance from an ideal and an anti-ideal point."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.operators.ranking import distributed_rank
from siltline.session import cut

#: A score vector with one in so many of all rows and more is hot; its rows are spread over so many join keys.
_HOT, _SALTS = 256, 32
#: What the severities count.
SEVERITY = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0, "info": 0.0}


def ideal_point_ranking(
    df: DataFrame, group: Sequence[str], key: str, scores: Mapping[str, float], tails: tuple[float, float] = (0.01, 0.99), neutral: Mapping[str, float] | None = None
) -> DataFrame:
    """Group columns, key, scores, closeness in [0, 1] and rank within the group (1 = best; equal scores share a rank).

    ``scores`` maps columns, of which more is better, to weights. Each score is winsorised at the quantiles ``tails``
    of the whole table, divided by its root of squares within the group, weighted, and compared with the best and
    worst values of the group. A missing score takes the table's median (or ``neutral``), so it decides nothing. In a
    group of which all rows are equal, closeness is 0.5. Work is done per distinct score vector of a group, with its
    number of rows: a hot group shrinks before anything is shuffled or sorted. The quantiles are exact up to 10 000
    distinct values of a score, beyond that within a ten-thousandth of the rows. ``df`` is read several times: cut it.
    """
    names = list(scores)
    probs = [tails[0], 0.5, tails[1]]
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(c) for c in names]).first()  # three numbers a score
    columns = []
    for i, c in enumerate(names):
        low, middle, high = cuts[i] or (0.0, 0.0, 0.0)
        value = F.coalesce(F.col(c).cast("double"), F.lit(float(neutral[c] if neutral and c in neutral else middle)))
        columns.append(F.greatest(F.lit(low), F.least(F.lit(high), value)).alias(f"_x{i}"))
    clean = df.select(*group, key, *names, *columns)
    xs = [f"_x{i}" for i in range(len(names))]
    vectors = cut(clean.groupBy(*group, *xs).agg(F.count("*").alias("_n")))
    norms = vectors.groupBy(*group).agg(
        *[F.sqrt(F.sum(F.col(x) * F.col(x) * F.col("_n"))).alias(f"_l{i}") for i, x in enumerate(xs)],
        *[F.max(x).alias(f"_b{i}") for i, x in enumerate(xs)],
        *[F.min(x).alias(f"_w{i}") for i, x in enumerate(xs)],
    )
    on = _same("v", "g", group)
    both = vectors.alias("v").join(norms.alias("g"), on)
    total = float(sum(scores.values()))

    def distance(end: str) -> Column:
        parts = []
        for i, c in enumerate(names):
            scale = F.when(F.col(f"_l{i}") > 0, F.lit(scores[c] / total) / F.col(f"_l{i}")).otherwise(0.0)
            parts.append(F.pow((F.col(f"_x{i}") - F.col(f"{end}{i}")) * scale, F.lit(2.0)))
        return F.sqrt(sum(parts[1:], parts[0]))

    best, worst = distance("_b"), distance("_w")
    closeness = F.round(F.when(best + worst > 0, worst / (best + worst)).otherwise(0.5), 9)
    scored = both.select(*[F.col(f"v.{g}") for g in group], *xs, "_n", closeness.alias("closeness"))
    levels = scored.groupBy(*group, "closeness").agg(F.sum("_n").alias("_n"))
    ranked = distributed_rank(levels, group, [F.col("closeness").desc()], "_n")
    places = scored.alias("v").join(ranked.alias("g"), _same("v", "g", [*group, "closeness"])).select(
        *[F.col(f"v.{c}") for c in [*group, *xs, "closeness"]], F.col("rank")
    )
    # rows meet their vector's place by key; a vector that many rows have is spread over several keys
    vector = F.xxhash64(*group, *xs)
    every = vectors.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in vectors.where(F.col("_n") * _HOT >= every).select(vector).collect()]  # at most _HOT by definition
    is_hot = vector.isin(hot) if hot else F.lit(False)
    salted = clean.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(key), F.lit(_SALTS)).cast("int")).otherwise(0))
    spread = places.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.alias("v").join(spread.alias("g"), _same("v", "g", [*group, *xs, "_salt"])).select(*[F.col(f"v.{c}") for c in [*group, key, *names]], "closeness", "rank")


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def finding_scores(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """finding_id, scan_id, repo and the three scores of each finding, once each, ai confidence in 0..100.

    The unit of ai.confidence is told per tool version by its greatest value: at most 1 means a fraction. Unknown and
    null severities, and missing numbers, stay null.
    """
    order = F.struct(F.col("loaded_at").isNotNull(), "loaded_at", F.xxhash64("severity", "confidence", "ai.confidence"))
    latest = F.max_by(F.struct("scan_id", "repo", "severity", "confidence", F.col("ai.confidence").alias("ai_confidence")), order).alias("f")
    rows = findings.groupBy("finding_id").agg(latest).select("finding_id", "f.*")
    versions = scans.groupBy("scan_id").agg(F.max("tool_version").alias("tool_version"))
    rows = rows.join(versions, "scan_id", "left")
    units = rows.groupBy("tool_version").agg(F.max("ai_confidence").alias("_most"))  # a row per tool version
    rows = rows.alias("r").join(units.alias("u"), _same("r", "u", ["tool_version"]), "left")
    level = F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])
    ai = F.when(F.col("_most") <= 1.0, F.col("ai_confidence") * 100).otherwise(F.col("ai_confidence"))
    severity = F.try_element_at(level, F.lower(F.trim("severity")))
    return rows.select("finding_id", "scan_id", "repo", severity.alias("severity_level"), F.col("confidence").cast("double").alias("confidence"), F.round(ai, 6).alias("ai_confidence"))


WEIGHTS = {"severity_level": 1.0, "confidence": 1.0, "ai_confidence": 1.0}


def rank_findings(findings: DataFrame, scans: DataFrame, group: Sequence[str]) -> DataFrame:
    return ideal_point_ranking(cut(finding_scores(findings, scans)), group, "finding_id", WEIGHTS)
