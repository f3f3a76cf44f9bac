"""Dependency manifests at the root of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import each
from palisade.rules.stacks import PORT_PATTERN, PORT_SCRIPTS, PROJECT_FILES

_MANIFESTS = {
    "js": ("package.json", ("dependencies", "devDependencies")),
    "php": ("composer.json", ("require", "require-dev")),
}


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """``project_id, ecosystem, dep``: lower-case dependency names; invalid JSON gives none (SRC-2)."""
    out = None
    for ecosystem, (name, sections) in _MANIFESTS.items():
        schema = "struct<" + ",".join(f"`{s}`:map<string,string>" for s in sections) + ">"
        parsed = files.filter(F.col("path") == name).select(
            "project_id", F.from_json("content", schema).alias("m"))
        keys = [F.coalesce(F.map_keys(F.col(f"m.`{s}`")), F.array().cast("array<string>")) for s in sections]
        deps = each(parsed, F.array_union(*keys), "dep", "project_id", F.lit(ecosystem).alias("ecosystem"))
        deps = deps.withColumn("dep", F.lower("dep"))
        out = deps if out is None else out.unionByName(deps)
    return out.distinct()


def manifest_profile(files: DataFrame) -> DataFrame:
    """``project_id, has_project_file, port_hint``: one row per project (SRC-3)."""
    port = F.coalesce(*[
        F.nullif(F.regexp_extract(F.get_json_object("content", f"$.scripts.{s}"), PORT_PATTERN, 1), F.lit(""))
        for s in PORT_SCRIPTS
    ]).cast("int")
    # contents are read only where the pushed path filter lets them
    ports = files.filter(F.col("path") == "package.json").select("project_id", port.alias("port_hint"))
    named = files.groupBy("project_id").agg(F.bool_or(F.col("path").isin(*PROJECT_FILES)).alias("has_project_file"))
    return named.join(ports, "project_id", "left")
