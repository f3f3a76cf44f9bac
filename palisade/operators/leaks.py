"""Environment values written into source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.env_scan import env_values, last_env_value
from palisade.operators.occurrences import literal_occurrences
from palisade.schema import as_findings
from palisade.sources.files import select_files

MIN_LITERAL = 20


def hardcoded_env_values(files: DataFrame, env_vars: DataFrame | None = None,
                         broadcast: bool | None = None) -> DataFrame:
    """Environment values of at least 20 characters in files of the literal profile (JN-1).

    One finding per variable and file, at the first line.
    """
    variables = last_env_value(env_values(files) if env_vars is None else env_vars)
    variables = variables.filter(F.length("value") >= MIN_LITERAL).drop("first_seen")
    texts = select_files(files, "literal").select(
        "project_id", F.col("path").alias("file"), F.col("content").alias("text"))
    found = literal_occurrences(texts, variables, ["file"], size=MIN_LITERAL, broadcast=broadcast)
    name = F.col("key")
    return as_findings(
        found.select(
            "project_id", "file", "line", F.lit("leak.hardcoded_env").alias("rule_id"),
            F.lit("critical").alias("severity"),
            F.concat(F.lit("Hardcodet secret ("), name, F.lit(") fundet i kildekode")).alias("description"),
            F.concat(F.lit("Værdien fra "), F.col("source"),
                     F.lit(" er hardcodet i stedet for at bruge env-variablen. Fjern værdien og brug process.env."),
                     name, F.lit(" / import.meta.env."), name).alias("detail"),
            name.alias("env_var"), F.col("source").alias("env_source"),
        ), "leak")
