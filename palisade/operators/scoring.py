"""From findings to counts, scores, verdicts and fleet views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.rules.guidance import SEVERITY_ORDER, SEVERITY_PENALTY, VERDICTS


def union_findings(*scans: DataFrame) -> DataFrame:
    """All findings as a bag (SO-1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _count(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity).alias(severity)


def severity_counts(findings: DataFrame, by: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Findings per severity (AG-1)."""
    return findings.groupBy(*by).agg(*[_count(s) for s in SEVERITY_ORDER])


def score_of(critical: Column, warning: Column, info: Column) -> Column:
    loss = (critical * SEVERITY_PENALTY["critical"] + warning * SEVERITY_PENALTY["warning"]
            + info * SEVERITY_PENALTY["info"])
    return F.greatest(F.lit(0), 100 - loss)


def verdict_of(score: Column) -> Column:
    chain = None
    for floor, text in VERDICTS[:-1]:
        chain = F.when(score >= floor, text) if chain is None else chain.when(score >= floor, text)
    return chain.otherwise(VERDICTS[-1][1])


def risk_score(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts and score of every project; one without findings has 100 (AG-2)."""
    counts = severity_counts(findings)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (projects.select("project_id").distinct().join(counts, "project_id", "left")
            .select("project_id", *[zero(s) for s in SEVERITY_ORDER])
            .withColumn("score", score_of(*[F.col(s) for s in SEVERITY_ORDER])))


def verdict(scores: DataFrame) -> DataFrame:
    """Bucket of a score (AG-3)."""
    return scores.withColumn("verdict", verdict_of(F.col("score")))


def gate(findings: DataFrame) -> DataFrame:
    """``failed`` where any finding is critical (AG-4)."""
    return findings.groupBy("project_id").agg(F.bool_or(F.col("severity") == "critical").alias("failed"))


def scorecard(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts, score, verdict and gate in one row per project."""
    return verdict(risk_score(projects, findings)).withColumn("failed", F.col("critical") > 0)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity)


def severity_listing(findings: DataFrame) -> DataFrame:
    """Findings in reading order: severity, file, line (TK-2)."""
    return findings.orderBy(severity_rank(F.col("severity")), "project_id", "file", "line", "description")


def leak_spread(findings: DataFrame) -> DataFrame:
    """Distinct files per environment variable and per rule (FL-1)."""
    kind = F.when(F.col("env_var").isNotNull(), "env_var").otherwise("rule")
    return (findings.filter(F.col("file").isNotNull())
            .select("project_id", kind.alias("kind"), F.coalesce("env_var", "rule_id").alias("name"), "file").distinct()
            .groupBy("project_id", "kind", "name").agg(F.count(F.lit(1)).alias("files")))


def worst_projects(scores: DataFrame, k: int = 10) -> DataFrame:
    """``k`` lowest scores, ties by name (FL-3)."""
    return scores.orderBy("score", "project_id").limit(k)
