"""Version control: ignore files, tracked environment files, secrets in history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.matching import all_matches, rule_fields
from palisade.functions.text import each, numbered_lines, strip
from palisade.rules.model import Rule
from palisade.rules.secrets import COMMIT_RULES, CRITICAL_IGNORES, REQUIRED_IGNORES
from palisade.schema import as_findings
from palisade.sources.commits import is_env_path
from palisade.sources.files import projects_of


def _covers(line: Column, required: str) -> Column:
    """A line covers a pattern if either contains the other, or its stem starts the pattern."""
    name = F.lit(required)
    test = line.contains(required) | name.contains(line)
    test = test | (line.endswith("*") & name.startswith(F.regexp_replace(line, r".$", "")))
    test = test | (line.endswith(".*") & name.startswith(F.regexp_replace(line, r"..$", "")))
    if required.startswith(".env"):
        stem = F.regexp_replace(line, r"[*.]+$", "")
        test = test | (line.startswith(".env") & (line.isin(".env*", ".env", ".env.*") | name.startswith(stem)))
    return test


def ignore_coverage(files: DataFrame) -> DataFrame:
    """Required ignore lines a project lacks, or the lack of the whole file (JN-11).

    The required lines are literals tested inside the project's row, so nothing is multiplied.
    """
    # the project list reads one narrow column; the path filter reaches the scan that reads contents
    root = projects_of(files).join(
        files.filter(F.col("path") == ".gitignore").select("project_id", "content"), "project_id", "left")
    lines = F.filter(
        F.transform(numbered_lines(F.col("content")), lambda l: strip(l["text"])),
        lambda t: (t != "") & ~t.startswith("#"))

    def lacking(required: str) -> Column:
        severity = "critical" if required in CRITICAL_IGNORES else "warning"
        return F.when(~F.exists(F.col("_lines"), lambda t: _covers(t, required)), F.struct(
            F.lit("repo.ignore_gap").alias("rule_id"), F.lit(severity).alias("severity"),
            F.lit(f"'{required}' er ikke dækket af .gitignore").alias("description"),
            F.lit(f"Tilføj '{required}' til .gitignore for at beskytte sensitive filer").alias("detail")))

    missing = F.struct(
        F.lit("repo.no_ignore_file").alias("rule_id"), F.lit("critical").alias("severity"),
        F.lit(".gitignore fil mangler helt").alias("description"),
        F.lit("Opret en .gitignore fil omgående – alle .env-filer er i fare").alias("detail"))
    gaps = F.filter(F.array(*[lacking(r) for r in REQUIRED_IGNORES]), lambda g: g.isNotNull())
    found = F.when(F.col("content").isNull(), F.array(missing)).otherwise(gaps)
    return as_findings(each(root.withColumn("_lines", lines), found, "g", "project_id").select("project_id", "g.*"), "repo")


def tracked_env_files(tracked: DataFrame) -> DataFrame:
    """Environment files under version control (JN-12)."""
    path = F.col("path")
    return as_findings(
        tracked.filter(is_env_path(path)).select(
            "project_id", F.lit("repo.tracked_env").alias("rule_id"), F.lit("critical").alias("severity"),
            F.concat(F.lit("'"), path, F.lit("' er tracked af git")).alias("description"),
            F.concat(F.lit("Kør: git rm --cached "), path, F.lit(" && echo '"), path,
                     F.lit("' >> .gitignore")).alias("detail"),
            path.alias("file")), "repo")


def scan_commit_patches(lines: DataFrame, rules: Sequence[Rule] = COMMIT_RULES,
                        changes: Sequence[str] | None = None) -> DataFrame:
    """Every rule on every patch line: ``project_id, rule_id, commit_sha, committed_at, path, line_no`` (RS-4).

    ``changes`` restricts the kinds of patch line (``+``, ``-`` or blank); by default all are read.
    """
    if changes is not None:
        lines = lines.filter(F.col("change").isin(*changes))
    return (
        each(lines, all_matches(rules, "line"), "rule_order", "project_id", "commit_sha", "committed_at", "path", "line_no")
        .select("project_id", "commit_sha", "committed_at", "path", "line_no",
                *rule_fields(rules, "rule_order"))
    )


def first_leak_commit(hits: DataFrame) -> DataFrame:
    """Newest commit with a matching line, per project and rule (WD-6)."""
    order = F.struct(-F.unix_micros("committed_at"), "commit_sha", "path", "line_no")
    return (hits.groupBy("project_id", "rule_id", "severity", "description")
            .agg(F.min_by("commit_sha", order).alias("commit_sha")))


def commit_findings(lines: DataFrame, rules: Sequence[Rule] = COMMIT_RULES) -> DataFrame:
    leaks = first_leak_commit(scan_commit_patches(lines, rules))
    return as_findings(
        leaks.withColumn("detail", F.concat(
            F.lit("Mønster matchede i commit ~"), F.substring("commit_sha", 1, 8),
            F.lit(". Brug 'git filter-repo' eller BFG Repo-Cleaner til at fjerne det.")))
        .withColumn("description", F.concat(F.lit("Secret fundet i git-historik: "), F.col("description"))),
        "history")
