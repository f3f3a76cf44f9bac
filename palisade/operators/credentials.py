"""Keys and tokens held in environment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.rules.secrets import JWT_PAYLOAD, URL_VALUE

MIN_KEY_CHARS = 20
_FIRST = ("first_rank", "source", "line")


def jwt_role(token: Column) -> Column:
    """The ``role`` claim of a three-part token, or null if it cannot be read."""
    parts = F.split(token, r"\.")
    payload = F.translate(parts[1], "-_", "+/")
    padded = F.rpad(payload, (F.ceil(F.length(payload) / 4) * 4).cast("int"), F.lit("="))
    claims = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(F.size(parts) == 3, F.get_json_object(claims, "$.role"))


def role_from_name(name: Column) -> Column:
    upper = F.upper(name)
    return F.when(upper.contains("SERVICE"), "service_role").when(upper.contains("ANON"), "anon").otherwise("unknown")


def credential_inventory(env_vars: DataFrame) -> DataFrame:
    """Values long enough to be keys, with their kind and role (AG-7)."""
    is_jwt = F.col("value").rlike(JWT_PAYLOAD)
    claimed = F.when(is_jwt, jwt_role(F.col("value")))
    known = F.when((claimed != "") & (claimed != "unknown"), claimed)
    return env_vars.filter(F.length("value") >= MIN_KEY_CHARS).select(
        "project_id", F.col("key").alias("var"), F.col("value").alias("token"),
        F.coalesce(known, role_from_name(F.col("key"))).alias("role"), is_jwt.alias("is_jwt"),
        "source", "line", "first_rank")


def credential_dedup(credentials: DataFrame) -> DataFrame:
    """First variable per token (WD-4), combined before the shuffle."""
    rest = ["var", "role", "is_jwt", "source", "line", "first_rank"]
    return (credentials.groupBy("project_id", "token")
            .agg(F.min_by(F.struct(*rest), F.struct(*_FIRST)).alias("_c"))
            .select("project_id", "token", "_c.*"))


def credential_summary(env_vars: DataFrame) -> DataFrame:
    """Per project the first service key, the first public key (or unknown one) and the first URL (AG-8)."""
    order = F.struct(*_FIRST)
    keys = credential_inventory(env_vars).select(
        "project_id", *_FIRST, F.col("var").alias("key"), F.col("token").alias("value"), "role",
        F.lit(False).alias("is_url"))
    urls = env_vars.filter(F.col("value").rlike(URL_VALUE)).select(
        "project_id", *_FIRST, "key", "value",
        F.lit(None).cast("string").alias("role"), F.lit(True).alias("is_url"))

    def first(test: Column) -> Column:
        return F.min_by(F.when(test, F.struct("value", "key")), F.when(test, order))

    return (
        keys.unionByName(urls).groupBy("project_id").agg(
            first(F.col("role").isin("anon", "unknown")).alias("a"),
            first(F.col("role") == "service_role").alias("s"),
            first(F.col("is_url")).alias("u"))
        .select("project_id",
                F.col("a.value").alias("anon_key"), F.col("a.key").alias("anon_key_var"),
                F.col("s.value").alias("service_role_key"), F.col("s.key").alias("service_role_var"),
                F.col("u.value").alias("url"), F.col("u.key").alias("url_var"))
    )
