"""Which datastores a project uses, found in four layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import each, lit_array, strip
from palisade.operators.credentials import credential_summary
from palisade.operators.env_scan import env_values, explode_lines
from palisade.rules.datastores import (
    BODY_TYPE_PATTERNS, DIALECT_PATTERN, HEADER_TYPES, HINT_KEYS, HINTS, KEY_NAME_PATTERNS, ORM_PROVIDERS,
    ORM_PROVIDER_PATTERN, ORM_URL_ENV_PATTERN, ORM_URL_PATTERN, VALUE_PATTERNS,
)
from palisade.rules.profiles import PROFILES
from palisade.rules.secrets import JWT_PAYLOAD, URL_VALUE_OF_KEY_LAYER
from palisade.schema import as_findings
from palisade.sources.files import in_profile, select_files

def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def key_name_technology(key: Column) -> Column:
    return F.coalesce(*[F.when(key.rlike(p), F.lit(tech)) for p, tech in KEY_NAME_PATTERNS])


def datastore_by_key_name(files: DataFrame) -> DataFrame:
    """Technology named by environment variables, one row per project (JN-6).

    The first pattern decides per variable, the first variable decides the type; the first URL and the
    first token may come from later variables.
    """
    lines = explode_lines(select_files(files, "datastore_names").select("project_id", "path", "content"))
    parts = F.split("_t", "=", 2)
    value = F.btrim(F.btrim(strip(parts[1]), F.lit('"')), F.lit("'"))
    named = (
        lines.withColumn("_t", strip(F.col("text")))
        .filter((F.col("_t") != "") & ~F.col("_t").startswith("#") & F.col("_t").contains("="))
        .select("project_id", "path", "line", strip(parts[0]).alias("key"), value.alias("value"))
        .filter((F.col("value") != "") & ~F.col("value").startswith("your_") & (F.col("value") != "xxx"))
        .withColumn("tech", key_name_technology(F.col("key"))).filter(F.col("tech").isNotNull())
    )
    order = F.struct("path", "line")

    def first(test: Column, what: Column) -> Column:
        return F.min_by(F.when(test, what), F.when(test, order))

    is_url = F.col("value").rlike(URL_VALUE_OF_KEY_LAYER)
    return (
        named.groupBy("project_id").agg(
            F.min_by(F.struct("tech", "key", "path"), order).alias("t"),
            first(is_url, F.col("value")).alias("url"),
            first(F.col("value").rlike(JWT_PAYLOAD), F.col("value")).alias("anon_key"))
        .select("project_id", F.col("t.tech").alias("type"), F.col("t.key").alias("key_env_var"),
                F.col("t.path").alias("key_source"), "url", "anon_key")
    )


def with_value_hits(files: DataFrame) -> DataFrame:
    """Files with ``value_hits``: the first match of every value pattern, null outside the profile.

    A pattern's match lies within one line, so only the lines that hold ``://`` or the beginning of a key are looked at.
    """
    def may(text: Column) -> Column:
        return text.contains("://") | text.contains("eyJ") | text.contains("AIza") | F.lower(text).contains("fnaeta")

    lines = F.array_join(F.filter(F.split("content", "[\\n\\r]"), may), "\n")
    found = F.transform(F.array(lines), lambda text: F.filter(
        F.array(*[F.struct(F.lit(i).alias("n"), _found(text, p).alias("v")) for i, (p, _, _) in enumerate(VALUE_PATTERNS, 1)]),
        lambda s: s["v"].isNotNull()))[0]
    return files.withColumn("value_hits", F.when(in_profile(PROFILES["datastore"]) & may(F.col("content")), found))


def value_hits(files: DataFrame) -> DataFrame:
    """First match of every value pattern in every file: ``project_id, path, pattern_no, type, field, value``."""
    looked = files if "value_hits" in files.columns else with_value_hits(select_files(files, "datastore"))
    return (
        each(looked, F.col("value_hits"), "h", "project_id", "path")
        .select("project_id", "path", F.col("h.n").alias("pattern_no"),
                F.get(lit_array([t for _, t, _ in VALUE_PATTERNS]), F.col("h.n") - 1).alias("type"),
                F.get(lit_array([f for _, _, f in VALUE_PATTERNS]), F.col("h.n") - 1).alias("field"),
                F.col("h.v").alias("value"))
    )


def datastore_by_value(files: DataFrame) -> DataFrame:
    """Every technology whose connection format occurs, with its first file (JN-7, WD-9)."""
    return first_per_technology(value_hits(files).select(
        "project_id", "type", F.lit("env-value-scan").alias("method"), F.col("path").alias("url_source"),
        F.when(~F.col("field").isin("anon_key", "firebase_api_key"), F.col("value")).alias("url"),
        F.when(F.col("field") == "anon_key", F.col("value")).alias("anon_key"),
        F.when(F.col("field") == "firebase_api_key", F.col("value")).alias("firebase_api_key"),
        F.struct("path", "pattern_no").alias("_order")))


def first_per_technology(rows: DataFrame) -> DataFrame:
    """First row per project and technology by ``_order`` (WD-9), combined before the shuffle."""
    rest = [c for c in rows.columns if c not in ("project_id", "type", "_order")]
    return (rows.groupBy("project_id", "type").agg(F.min_by(F.struct(*rest), F.col("_order")).alias("_r"))
            .select("project_id", "type", "_r.*"))


def value_layer(files: DataFrame) -> DataFrame:
    """The value layer of a profile: first type, first URL, first key of each kind, per project."""
    hits = value_hits(files)
    order = F.struct("path", "pattern_no")

    def first(test: Column) -> Column:
        return F.min_by(F.when(test, F.col("value")), F.when(test, order))

    keys = F.col("field").isin("anon_key", "firebase_api_key")
    return hits.groupBy("project_id").agg(
        F.min_by("type", order).alias("type"),
        first(~keys).alias("url"),
        first(F.col("field") == "anon_key").alias("anon_key"),
        first(F.col("field") == "firebase_api_key").alias("firebase_api_key"))


def schema_hits(files: DataFrame) -> DataFrame:
    """Technology declared by every ORM schema and configuration, one row per file."""
    text = F.col("content")
    provider = F.lower(_found(text, ORM_PROVIDER_PATTERN, 1))
    known = F.coalesce(*[F.when(F.col("provider") == p, F.lit(t)) for p, t in ORM_PROVIDERS.items()],
                       F.concat(F.lit("Database (Prisma/"), F.col("provider"), F.lit(")")))
    dialect = _found(text, DIALECT_PATTERN, 1)
    is_schema = F.col("name") == "schema.prisma"
    chosen = select_files(files, "schema").withColumn("provider", F.when(is_schema, provider))
    usable = F.when(is_schema, F.col("provider").isNotNull()).otherwise(
        F.lower(text).contains("drizzle") | F.lower(text).contains("dialect"))
    return chosen.filter(usable).select(
        "project_id",
        F.when(is_schema, known).when(dialect.isNotNull(), F.concat(F.lit("Database (Drizzle/"), dialect, F.lit(")")))
        .otherwise("Database (Drizzle ORM)").alias("type"),
        is_schema.alias("prisma"), F.col("path").alias("schema_file"), F.col("provider").alias("provider"),
        F.when(is_schema, _found(text, ORM_URL_ENV_PATTERN, 1)).alias("url_env_var"),
        F.when(is_schema, _found(text, ORM_URL_PATTERN, 1)).alias("url"))


def datastore_by_schema(files: DataFrame) -> DataFrame:
    """Technology declared by an ORM schema, else by its configuration: the first file stands for the project (JN-8)."""
    hits = schema_hits(files)
    rest = [c for c in hits.columns if c != "project_id"]
    return (hits.groupBy("project_id").agg(F.min_by(F.struct(*rest), F.struct(~F.col("prisma"), F.col("schema_file"))).alias("r"))
            .select("project_id", "r.*"))


def datastore_by_response(responses: DataFrame) -> DataFrame:
    """Technology visible in a response, one row per URL (JN-9).

    The first body pattern that matches decides, then header names; keys are read in any case.
    """
    body = F.col("body")
    decided = F.coalesce(*[F.when(body.rlike(p), F.lit(i)) for i, (p, _) in enumerate(BODY_TYPE_PATTERNS)])
    by_header = [F.when(F.map_contains_key("headers", h), F.lit(t)) for h, t in HEADER_TYPES]
    last_header = F.coalesce(*[F.when(F.map_contains_key("headers", h), F.lit(h)) for h, _ in reversed(HEADER_TYPES)])
    key, fb_key, mongo = 1, 3, len(BODY_TYPE_PATTERNS) - 1
    url = F.coalesce(*[F.when(F.col("_n") == i, _found(body, p)) for i, (p, _) in enumerate(BODY_TYPE_PATTERNS)
                       if i not in (key, fb_key, mongo)])
    by_body = F.get(lit_array([t for _, t in BODY_TYPE_PATTERNS]), F.col("_n"))
    return (
        responses.withColumn("_n", decided).withColumn("type", F.coalesce(by_body, *by_header))
        .filter(F.col("type").isNotNull())
        .select("project_id", F.col("url").alias("page_url"), "type", url.alias("url"),
                _found(body, BODY_TYPE_PATTERNS[key][0]).alias("anon_key"),
                _found(body, BODY_TYPE_PATTERNS[fb_key][0]).alias("firebase_api_key"),
                F.when(F.col("_n") == mongo, _found(body, BODY_TYPE_PATTERNS[mongo][0])).alias("mongodb_url"),
                last_header.alias("header_detected"))
    )


def response_layer(responses: DataFrame) -> DataFrame:
    """One response per project stands for it: the first URL that shows a technology."""
    rows = datastore_by_response(responses)
    rest = [c for c in rows.columns if c not in ("project_id", "page_url")]
    return (rows.groupBy("project_id").agg(F.min_by(F.struct(*rest), F.col("page_url")).alias("r"))
            .select("project_id", "r.*"))


_COLUMNS = {
    "type": "string", "url": "string", "anon_key": "string", "firebase_api_key": "string", "mongodb_url": "string",
    "header_detected": "string", "key_env_var": "string", "key_source": "string", "prisma": "boolean",
    "schema_file": "string", "provider": "string", "url_env_var": "string", "anon_key_var": "string",
    "url_var": "string", "service_role_key": "string", "service_role_var": "string",
}


def _layer(rows: DataFrame, name: str) -> DataFrame:
    have = set(rows.columns)
    return rows.select("project_id", F.lit(name).alias("layer"), F.struct(*[
        (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in _COLUMNS.items()]).alias("r"))


def masked_key(key: Column, name: str) -> list[Column]:
    """The first characters of a key, and a hash that tells keys apart."""
    return [F.concat(F.substring(key, 1, 8), F.lit("***")).alias(name), F.sha2(key, 256).alias(f"{name}_hash")]


def masked_url(url: Column) -> Column:
    """A whole URL without the user and password in it."""
    return F.regexp_replace(url, r"://[^/@\s]*@", "://***@")


def datastore_profile(files: DataFrame, responses: DataFrame | None = None, env_vars: DataFrame | None = None,
                      guess_hosted: bool = True) -> DataFrame:
    """One row per project from all layers: response, schema, key names, values, extraction (AG-5).

    Earlier layers win and later ones fill what is empty; the key-name layer counts only where no earlier
    layer named a type.  Keys are shown by their first characters and told apart by a hash; URLs lose their user and password.  With ``guess_hosted`` a project of which only a key or a URL is known is taken to
    use the hosted database.
    """
    env_vars = env_values(files) if env_vars is None else env_vars
    rows = (_layer(datastore_by_schema(files), "schema")
            .unionByName(_layer(datastore_by_key_name(files), "names"))
            .unionByName(_layer(value_layer(files), "values"))
            .unionByName(_layer(credential_summary(env_vars), "extracted")))
    if responses is not None:
        rows = rows.unionByName(_layer(response_layer(responses), "response"))
    names = ("response", "schema", "names", "values", "extracted")
    wide = rows.groupBy("project_id").agg(*[F.max(F.when(F.col("layer") == n, F.col("r"))).alias(n) for n in names])

    answered = F.col("response.type").isNotNull()
    declared = answered | F.col("schema.type").isNotNull()
    by_name = lambda c: F.when(~declared, F.col(f"names.{c}"))
    by_schema = lambda c: F.when(~answered, F.col(f"schema.{c}"))
    known_url = F.coalesce(F.col("response.url"), by_schema("url"), by_name("url"), F.col("values.url"))
    known_key = F.coalesce(F.col("response.anon_key"), by_name("anon_key"), F.col("values.anon_key"))
    kinds = [F.col(f"{n}.type") for n in names[:4]]
    if guess_hosted:
        hint = F.col("extracted.anon_key").isNotNull() | F.col("extracted.url").isNotNull()
        kinds.append(F.when(hint, F.lit("Supabase")))
    methods = {"response": "header-first", "schema": "prisma-schema", "names": "env-key-name", "values": "env-value-scan"}
    return wide.select(
        "project_id",
        F.coalesce(*kinds).alias("type"),
        F.coalesce(*[F.when(F.col(f"{n}.type").isNotNull(), F.lit(m)) for n, m in methods.items()]).alias("method"),
        masked_url(F.coalesce(known_url, F.col("extracted.url"))).alias("url"),
        F.when(known_url.isNull(), F.col("extracted.url_var")).alias("url_var"),
        *masked_key(F.coalesce(known_key, F.col("extracted.anon_key")), "anon_key"),
        F.when(known_key.isNull(), F.col("extracted.anon_key_var")).alias("anon_key_var"),
        *masked_key(F.col("extracted.service_role_key"), "service_role_key"),
        F.col("extracted.service_role_var").alias("service_role_var"),
        *masked_key(F.coalesce("response.firebase_api_key", "values.firebase_api_key"), "firebase_api_key"),
        masked_url(F.col("response.mongodb_url")).alias("mongodb_url"),
        F.col("response.header_detected").alias("header_detected"),
        by_name("key_env_var").alias("key_env_var"), by_name("key_source").alias("key_source"),
        F.col("schema.prisma").alias("prisma"), F.col("schema.schema_file").alias("schema_file"),
        F.col("schema.provider").alias("provider"), by_schema("url_env_var").alias("url_env_var"),
    )


def datastore_list(files: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Every technology of a project, from all its responses, schemas and files (AG-6).

    Per technology the first layer wins, and in it the first place; responses are not needed. The layers are added up in one aggregation by
    project and technology, combined before the shuffle.
    """
    kept = ("url", "anon_key", "firebase_api_key", "schema_file", "prisma", "provider", "url_env_var")

    def part(rows: DataFrame, rank: int, method: str, place: str) -> DataFrame:
        have = set(rows.columns)
        return rows.select(
            "project_id", "type", F.lit(method).alias("method"),
            *[(F.col(c) if c in have else F.lit(None)).cast(_COLUMNS[c]).alias(c) for c in kept],
            F.struct(F.lit(rank).alias("rank"), F.col(place).alias("place")).alias("_order"))

    rows = (part(schema_hits(files), 1, "prisma-schema", "schema_file")
            .unionByName(part(datastore_by_value(files), 2, "env-value-scan", "url_source")))
    if responses is not None:
        rows = rows.unionByName(part(datastore_by_response(responses), 0, "header-first", "page_url"))
    return first_per_technology(rows)


def datastore_hints(datastores: DataFrame) -> DataFrame:
    """Advice for the first hint key contained in a technology's name, and for ORM settings (JN-10).

    The hints are a fixed table of a few literal rows, kept in the expression.
    """
    kind = F.lower("type")
    key = F.coalesce(*[F.when(kind.contains(k.lower()), F.lit(k)) for k in HINT_KEYS])

    def hint(test: Column, severity, text, detail) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(test, F.struct(F.lit("datastore.hint").alias("rule_id"), F.lit(severity).alias("severity"),
                                     as_col(text).alias("description"), F.lit(detail).alias("detail")))

    rows = [hint(F.col("_key") == k, sev, text, detail) for k, sev, text, detail in HINTS]
    uses_orm = F.coalesce("prisma", F.lit(False))
    rows.append(hint(uses_orm & F.col("url_env_var").isNotNull(), "info",
                     F.concat(F.lit("Prisma bruger env var '"), F.col("url_env_var"), F.lit("' til database URL")),
                     "Sørg for at denne variabel aldrig commites til git"))
    rows.append(hint(uses_orm & (F.col("provider") == "sqlite"), "warning",
                     "Prisma med SQLite – ikke egnet til produktionsbrug",
                     "Skift til PostgreSQL, MySQL eller andet produktionssystem"))
    return as_findings(
        each(datastores.withColumn("_key", key), F.filter(F.array(*rows), lambda h: h.isNotNull()), "h", "project_id")
        .select("project_id", "h.*"), "datastore")


def client_key_exposure(datastores: DataFrame) -> DataFrame:
    """Public keys of a hosted database that a client or a file shows (JN-18)."""
    place = F.when(F.col("method") == "header-first", "klient-HTML").otherwise("fil")
    rows = F.array(
        F.when(F.col("anon_key").isNotNull(), F.struct(
            F.lit("datastore.anon_key").alias("rule_id"),
            F.concat(F.lit("Supabase anon-nøgle eksponeret i "), place).alias("description"),
            F.concat(F.lit("Nøgle: "), F.substring("anon_key", 1, 30), F.lit("...")).alias("detail"))),
        F.when(F.col("firebase_api_key").isNotNull(), F.struct(
            F.lit("datastore.firebase_key").alias("rule_id"),
            F.lit("Firebase API-nøgle fundet i klientkode").alias("description"),
            F.concat(F.lit("Key: "), F.substring("firebase_api_key", 1, 20), F.lit("...")).alias("detail"))))
    return as_findings(
        each(datastores, F.filter(rows, lambda r: r.isNotNull()), "r", "project_id")
        .select("project_id", "r.*", F.lit("warning").alias("severity")), "datastore")
