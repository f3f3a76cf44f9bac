"""Source files: read them, and choose the ones a scan looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import file_ext, file_name
from palisade.rules.profiles import PROFILES, FileProfile


def read_file_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table ``project_id, path, content`` (``name`` and ``ext`` if stored, else derived)."""
    return with_name_parts(spark.read.parquet(path))


def read_file_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """A directory of projects: the first level below ``root`` is the project, the rest the path.

    Bytes that are not UTF-8 are dropped.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root = root.rstrip("/")
    inside = F.substring_index(F.col("path"), root + "/", -1)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return with_name_parts(reader.load(root).select(
        F.substring_index(inside, "/", 1).alias("project_id"),
        F.regexp_replace(inside, r"^[^/]*/", "").alias("path"),
        text.alias("content"),
    ))


def with_name_parts(files: DataFrame) -> DataFrame:
    if "name" not in files.columns:
        files = files.withColumn("name", file_name(F.col("path")))
    if "ext" not in files.columns:
        files = files.withColumn("ext", file_ext(F.col("name")))
    return files


def in_profile(profile: FileProfile) -> Column:
    """Allow-list and pruned directories as one predicate.

    The ``IN`` parts reach the parquet scan; the directory test looks at the path inside the project.
    """
    name = F.col("name")
    allowed = F.lit(False)
    if profile.extensions:
        allowed = allowed | F.col("ext").isin(*profile.extensions)
    if profile.names:
        allowed = allowed | name.isin(*profile.names)
    for prefix in profile.name_prefixes:
        allowed = allowed | name.startswith(prefix)
    for prefix in profile.skip_prefixes:
        allowed = allowed & ~name.startswith(prefix)
    if profile.excluded_dirs:
        pruned = F.array(*[F.lit(d) for d in profile.excluded_dirs])
        allowed = allowed & ~F.arrays_overlap(F.split("path", "/"), pruned)
    return allowed


def select_files(files: DataFrame, profile: str | FileProfile) -> DataFrame:
    """Files of a profile (SRC-1)."""
    chosen = PROFILES[profile] if isinstance(profile, str) else profile
    return with_name_parts(files).filter(in_profile(chosen))


def projects_of(files: DataFrame) -> DataFrame:
    return files.select("project_id").distinct()
