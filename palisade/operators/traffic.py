"""Browser traffic and pages: secrets, environment values and API calls seen by a client."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.matching import distinct_matches, rule_fields
from palisade.functions.text import each
from palisade.operators.occurrences import literal_occurrences
from palisade.rules.model import Rule
from palisade.rules.secrets import (
    API_CALL_LABELS, COMMON_VALUES, CREDENTIALS_IN_URL, CRITICAL_NAME_WORDS, MODE_VARIABLES, TRAFFIC_SECRETS,
)
from palisade.schema import as_findings

MIN_EXPOSED = 16
PREVIEW = 8

# where a finding in a text lies, and the columns that order findings of one project
_TEXT_ID = ["text_id", "source"]


def eligible_env_values(variables: DataFrame) -> DataFrame:
    """Variables whose value would be a leak in a browser, unique by value (PF-5).

    Takes the output of ``last_env_value``.  Of several variables with one value the first seen counts, and
    a URL counts only if it carries a user and password.
    """
    name = F.upper("key")
    usable = variables.filter(
        ~name.isin(*MODE_VARIABLES) & ~F.lower("value").isin(*COMMON_VALUES) & (F.length("value") >= MIN_EXPOSED))
    unique = (usable.groupBy("project_id", "value")
              .agg(F.min_by(F.struct("key", "source"), F.struct("first_seen", "key")).alias("_v"))
              .select("project_id", "value", "_v.key", "_v.source"))
    name = F.upper("key")
    critical = F.lit(False)
    for word in CRITICAL_NAME_WORDS:
        critical = critical | name.contains(word)
    return (unique.filter(~name.contains("URL") | F.col("value").rlike(CREDENTIALS_IN_URL))
            .withColumn("severity", F.when(critical, "critical").otherwise("warning")))


def is_scannable() -> Column:
    """Textual content (PF-6), whatever its size."""
    return F.col("content_type").rlike("json|javascript|text/")


def scannable_bodies(traffic: DataFrame) -> DataFrame:
    return traffic.filter(is_scannable() & (F.col("body") != ""))


def traffic_texts(traffic: DataFrame) -> DataFrame:
    """Request headers, request URLs and textual bodies as texts with a source label.

    ``project_id, text_id, ts, kind, source, text``; no row is multiplied beyond its own three texts.
    """
    headers = F.array_join(F.transform(F.map_entries("request_headers"),
                                       lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")
    where = F.concat(F.lit("["), F.col("method"), F.lit(" "), F.col("url"), F.lit("]"))

    def text(kind: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("source"), value.alias("text"))

    parts = F.array(
        text("header", F.concat(F.lit("request-header "), where), headers),
        text("url", F.concat(F.lit("request-url "), where), F.col("url")),
        text("body", F.concat(F.lit("response ["), F.col("url"), F.lit("]")),
             F.when(is_scannable(), F.col("body"))))
    return (
        each(traffic, F.filter(parts, _scanned), "p", "project_id", F.col("request_id").alias("text_id"), "ts")
        .select("project_id", "text_id", "ts", "p.*")
    )


def _scanned(part: Column) -> Column:
    return part["text"] != ""


def page_fragments(pages: DataFrame) -> DataFrame:
    """Texts a page carries outside its prose: ``project_id, text_id, kind, source, text`` (PF-8).

    Inline scripts, ``meta[content]``, all ``data-*`` of elements that hold a key, framework state and
    configuration objects.  State is read from the script's text, because nothing is executed.
    """
    html = F.col("html")
    all_of = lambda p, group: F.regexp_extract_all(html, F.lit(p), F.lit(group))
    attribute = lambda tag, name: F.coalesce(
        F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")),
        F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1), F.lit("")))

    def part(kind: str, label: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("source"), text.alias("text"))

    script = r"(?is)<script([^>]*)>(.*?)</script>"
    scripts = F.filter(F.arrays_zip(all_of(script, 1).alias("attrs"), all_of(script, 2).alias("text")),
                       lambda s: ~s["attrs"].rlike(r"(?i)\ssrc\s*=") & (F.length(s["text"]) > 10))
    inline = F.filter(
        F.transform(scripts, lambda s, i: part("script", F.concat(F.lit("inline-script["), i, F.lit("]")), s["text"])),
        _scanned)

    metas = F.transform(all_of(r"(?is)<meta\s[^>]*>", 0), lambda tag: part(
        "meta", F.concat(F.lit("meta["), F.coalesce(attribute(tag, "name"), attribute(tag, "property"), F.lit("?")),
                         F.lit("]")), attribute(tag, "content")))

    holders = all_of(r"(?is)<[a-z][^>]*\sdata-(?:key|token|api-key|secret)[\s=>][^>]*>", 0)
    pairs = F.flatten(F.transform(holders, lambda tag: F.regexp_extract_all(
        tag, F.lit(r"(?is)\s(data-[a-z0-9_-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))"), F.lit(1))))
    data = F.transform(pairs, lambda a: part(
        "data", F.concat(F.lit("data-attr["), F.lower(F.rtrim(F.substring_index(a, "=", 1))), F.lit("]")),
        F.regexp_replace(a, r"(?s)^[^=]*=\s*[\"'](.*)[\"']$", "$1")))

    states = F.array(*[
        part("state", F.lit(label), F.regexp_extract(html, pattern, 1)) for label, pattern in (
            ("window.__NEXT_DATA__", r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"),
            ("window.__NUXT_DATA__", r"(?s)window\.__NUXT__\s*=\s*(.*?)\s*;?\s*</script>"),
            ("window.__REMIX_DATA__", r"(?s)window\.__remixContext\s*=\s*(.*?)\s*;?\s*</script>"),
            ("window.ENV/config", r"(?s)window\.(?:ENV|env|config|CONFIG)\s*=\s*(\{.*?\})\s*(?:;|</script>)"),
        )])
    texts = F.concat(inline, F.filter(F.concat(metas, data, states), _scanned))
    return (each(pages, texts, "p", "project_id", F.col("page_id").alias("text_id"))
            .select("project_id", "text_id", "p.*"))


def secret_matches(text: str, rules: Sequence[Rule] = TRAFFIC_SECRETS) -> Column:
    """``array<struct<rule_order, match>>``: distinct matches, per rule (RS-5, WD-7)."""
    return distinct_matches(rules, text)


def scan_text_secrets(texts: DataFrame, rules: Sequence[Rule] = TRAFFIC_SECRETS) -> DataFrame:
    """Known secret formats in headers, bodies and fragments; URLs are not read (RS-5, WD-7).

    One pass without a shuffle: a text's matches are made distinct inside its row.  A match itself is not
    handed on: ``match_hash`` tells matches apart, ``detail`` shows the first characters.
    """
    keep = [c for c in texts.columns if c not in ("text", "kind")]
    where = F.concat(F.lit("Fundet i: "), F.col("source"), F.lit(" | Mønster: "),
                     F.substring("m.match", 1, PREVIEW), F.lit("***"))
    return (
        each(texts.filter(F.col("kind") != "url"), secret_matches("text", rules), "m", *keep)
        .select(*keep, *rule_fields(rules, "m.rule_order"), F.sha2("m.match", 256).alias("match_hash"), where.alias("detail"))
        .withColumn("dynamic_match", F.lit(False))
    )


def classify_api_calls(traffic: DataFrame, labels: Sequence[Rule] = API_CALL_LABELS) -> DataFrame:
    """Requests to known interfaces, with the first label that fits (RS-6)."""
    label = F.coalesce(*[F.when(F.col("url").rlike(r.regex), F.lit(r.description)) for r in labels])
    return (traffic.select("project_id", "request_id", "ts", "method", "url", "resource_type", label.alias("label"))
            .filter(F.col("label").isNotNull()))


def env_value_exposure(texts: DataFrame, patterns: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Environment values seen in a text, one row per text and variable (JN-2).

    ``patterns`` is the output of ``eligible_env_values``.  See ``literal_occurrences`` for the join.
    """
    extra = [c for c in ("ts",) if c in texts.columns]
    named = patterns.withColumnRenamed("source", "env_source")
    found = literal_occurrences(texts, named, _TEXT_ID + extra, size=MIN_EXPOSED, broadcast=broadcast)
    name, file = F.col("key"), F.col("env_source")
    return found.select(
        "project_id", *_TEXT_ID, *extra, F.lit("exposure.env_value").alias("rule_id"), "severity",
        F.concat(name, F.lit(" (fra "), file, F.lit(") eksponeret i browser")).alias("description"),
        F.concat(F.lit("Værdi starter med: "), F.substring("value", 1, PREVIEW), F.lit("*** | Fundet i: "),
                 F.col("source")).alias("detail"),
        name.alias("env_var"), "env_source", F.lit(True).alias("dynamic_match"))


def exposure_key() -> Column:
    """What makes two exposures the same: the place, and the variable or the kind and hash of the match (WD-10)."""
    return F.when(F.col("dynamic_match"), F.concat_ws("\u0001", F.lit("d"), "env_var", "source")
                  ).otherwise(F.concat_ws("\u0001", F.lit("s"), "description", "match_hash", "source"))


def exposure_dedup(exposures: DataFrame) -> DataFrame:
    """First exposure per project and key (WD-10), combined before the shuffle."""
    columns = exposures.columns
    order = F.struct("text_id", "source", "detail")
    return (exposures.withColumn("_key", exposure_key()).groupBy("project_id", "_key")
            .agg(F.min_by(F.struct(*[c for c in columns if c != "project_id"]), order).alias("r"))
            .select("project_id", "r.*").select(*columns))


def traffic_exposures(traffic: DataFrame, patterns: DataFrame, pages: DataFrame | None = None,
                      broadcast: bool | None = None) -> DataFrame:
    """All exposures of traffic and pages before deduplication."""
    texts = traffic_texts(traffic).drop("ts")
    if pages is not None:
        texts = texts.unionByName(page_fragments(pages))
    static = scan_text_secrets(texts)
    return static.unionByName(env_value_exposure(texts, patterns, broadcast), allowMissingColumns=True)


def traffic_findings(traffic: DataFrame, patterns: DataFrame, pages: DataFrame | None = None,
                     broadcast: bool | None = None) -> DataFrame:
    return as_findings(exposure_dedup(traffic_exposures(traffic, patterns, pages, broadcast)), "traffic")


def response_summary(traffic: DataFrame, patterns: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Per textual body its size, secrets and environment values (AG-11)."""
    bodies = scannable_bodies(traffic)
    static = F.size(secret_matches("body"))
    texts = bodies.select("project_id", F.col("request_id").alias("text_id"),
                                        F.lit("").alias("source"), F.col("body").alias("text"))
    found = literal_occurrences(texts, patterns.select("project_id", "value"), _TEXT_ID, size=MIN_EXPOSED, broadcast=broadcast)
    hits = found.groupBy("project_id", F.col("text_id").alias("request_id")).agg(F.count(F.lit(1)).alias("_n"))
    return (bodies.select("project_id", "request_id", "url", F.col("body_bytes").alias("size"),
                          static.cast("bigint").alias("secrets_found"))
            .join(hits, ["project_id", "request_id"], "left")
            .select("project_id", "request_id", "url", "size", "secrets_found",
                    F.coalesce("_n", F.lit(0)).alias("env_hits")))


def scan_coverage(projects: DataFrame, traffic: DataFrame, tables: DataFrame, credentials: DataFrame,
                  patterns: DataFrame, variables: DataFrame) -> DataFrame:
    """How much was looked at, per project (AG-10).

    Every input is counted per project first, so only counts are joined.
    """
    parts = {
        "requests": traffic, "tables_probed": tables, "keys_tested": credentials,
        "patterns_used": patterns, "env_variables": variables,
    }
    counts = None
    for name, part in parts.items():
        one = part.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    wide = counts.groupBy("project_id").agg(*[
        F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in parts])
    return projects.select("project_id").distinct().join(wide, "project_id", "left").select(
        "project_id", *[F.coalesce(name, F.lit(0)).alias(name) for name in parts])


def top_api_calls(labelled: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` labelled requests per project (TK-1); the limit acts before the shuffle."""
    w = Window.partitionBy("project_id").orderBy("ts", "request_id")
    return (labelled.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("project_id", "rank", "method", "url", "label"))


def top_key_labels(credentials: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` tested keys per project as labels (TK-1)."""
    w = Window.partitionBy("project_id").orderBy("first_rank", "source", "line")
    label = F.concat(F.col("var"), F.lit(" (role: "), F.col("role"), F.lit(", jwt: "),
                     F.when(F.col("is_jwt"), "True").otherwise("False"), F.lit(")"))
    return (credentials.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("project_id", "rank", label.alias("label")))
