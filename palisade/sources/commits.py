"""Commit patches and tracked paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.rules.secrets import COMMIT_GLOBS

COMMITS_PER_PROJECT = 50


def _glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "\\" + c if c == "." else c for c in glob) + "$"


def in_commit_globs(path: Column, globs=COMMIT_GLOBS) -> Column:
    """A glob without a slash is a whole-path pattern: a star also crosses directories."""
    return path.rlike("|".join(_glob_regex(g) for g in globs))


def recent_commits(commits: DataFrame, limit: int = COMMITS_PER_PROJECT) -> DataFrame:
    """Newest ``limit`` commits per project with their rank (WD-5).

    The commit list is made distinct before ranking and the rank filter becomes a group limit, so
    each task sends at most ``limit`` rows of a project into the shuffle.
    """
    heads = commits.select("project_id", "commit_sha", "committed_at").distinct()
    newest = Window.partitionBy("project_id").orderBy(F.desc("committed_at"), "commit_sha")
    return heads.withColumn("commit_rank", F.row_number().over(newest)).filter(F.col("commit_rank") <= limit)


def commit_lines(commits: DataFrame, limit: int | None = None, globs=COMMIT_GLOBS) -> DataFrame:
    """Patch lines of the commits that touch the scanned paths (SRC-4); with a ``limit`` only of the newest of each project.

    Only commits touching such paths count toward the limit.  The join key holds the commit, so a
    project with most of the history still spreads over the cluster.
    """
    touched = commits.filter(in_commit_globs(F.col("path"), globs))
    if limit is None:
        return touched
    ranked = recent_commits(touched, limit).select("project_id", "commit_sha", "commit_rank")
    return touched.join(ranked, ["project_id", "commit_sha"])


def is_env_path(path: Column) -> Column:
    """Tracked environment files, by the same kind of whole-path pattern."""
    return path.contains(".env")
