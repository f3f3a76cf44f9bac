"""Which frameworks a project uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import each
from palisade.rules.stacks import JS_STACKS, PHP_STACKS, PYTHON_STACKS
from palisade.sources.manifests import manifest_dependencies


def _signatures() -> dict[str, dict[str, list[str]]]:
    table: dict[str, dict[str, list[str]]] = {}
    for ecosystem, stacks in (("js", JS_STACKS), ("php", PHP_STACKS)):
        for stack, deps in stacks.items():
            for dep in deps:
                table.setdefault(ecosystem, {}).setdefault(dep, []).append(stack)
    return table


def stack_from_deps(deps: DataFrame) -> DataFrame:
    """``project_id, stack`` for every dependency that is a signature (JN-3).

    The signatures are a literal table, joined by name as a broadcast of some fifty fixed rows.
    """
    rows = [(eco, dep, stack) for eco, by_dep in _signatures().items() for dep, st in by_dep.items() for stack in st]
    signatures = deps.sparkSession.createDataFrame(rows, "ecosystem string, dep string, stack string")
    return (deps.join(F.broadcast(signatures), ["ecosystem", "dep"])
            .select("project_id", "stack").distinct())


def stack_from_text(files: DataFrame) -> DataFrame:
    """``project_id, stack`` for Python frameworks named in a requirements file (JN-4)."""
    text = F.lower("content")
    found = F.filter(
        F.array(*[F.when(text.contains(sig), F.lit(stack)) for stack, sig in PYTHON_STACKS.items()]),
        lambda s: s.isNotNull())
    named = files.filter(F.col("path").isin("requirements.txt", "pyproject.toml"))
    return each(named, found, "stack", "project_id").distinct()


def project_stacks(files: DataFrame) -> DataFrame:
    """All labels of a project (SO-3)."""
    return stack_from_deps(manifest_dependencies(files)).unionByName(stack_from_text(files)).distinct()
