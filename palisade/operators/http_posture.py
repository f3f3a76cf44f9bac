"""Security of response headers.  Every job is one projection over the responses, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.rules.web import (
    COOKIE_TEXTS, CORS_CREDENTIALS, CSP_RULES, FINGERPRINTS, HEADER_RULES, HSTS_MIN_AGE, HSTS_NO_SUBDOMAINS,
)
from palisade.functions.text import SPACE, each
from palisade.schema import as_findings


def header(name: str) -> Column:
    return F.element_at("headers", name)


def _hit(test: Column, rule_id: str, name: str, severity: str, text, detail: Column) -> Column:
    text = text if isinstance(text, Column) else F.lit(text)
    return F.when(test, F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(name).alias("header"), F.lit(severity).alias("severity"),
        text.alias("description"), detail.alias("detail")))


def _findings(responses: DataFrame, hits: list[Column]) -> DataFrame:
    return as_findings(
        each(responses, F.filter(F.array(*hits), lambda h: h.isNotNull()), "h", "project_id", F.col("url").alias("source"))
        .select("project_id", "source", "h.*"), "http")


def presence_hits() -> list[Column]:
    hits = []
    for i, (name, check, text, severity) in enumerate(HEADER_RULES, 1):
        value = header(name)
        fails = {
            "present": value.isNull(),
            "absent": value.isNotNull(),
            "nosniff": value.isNull() | ~F.lower(value).contains("nosniff"),
            "not_wildcard": value.isNotNull() & (F.btrim(value, F.lit(SPACE)) == "*"),
        }[check]
        detail = F.when(value != "", F.concat(F.lit("Aktuel værdi: "), value)).otherwise("Header ikke tilstede")
        hits.append(_hit(fails, f"http.header_{i:02d}", name, severity, text, detail))
    return hits


def csp_hits() -> list[Column]:
    csp = header("content-security-policy")
    return [_hit(csp.rlike(p), f"http.csp_{i}", "content-security-policy", severity, text,
                 F.concat(F.lit("CSP: "), F.substring(csp, 1, 120)))
            for i, (p, text, severity) in enumerate(CSP_RULES, 1)]


def cookie_hits() -> list[Column]:
    cookie = F.lower(header("set-cookie"))
    given = F.coalesce(cookie != "", F.lit(False))
    lacks = lambda word: ~cookie.contains(word)
    tests = {
        "httponly": lacks("httponly"),
        "secure": lacks("secure"),
        "samesite": lacks("samesite"),
        "none_insecure": cookie.contains("samesite=none") & lacks("secure"),
    }
    return [_hit(given & test, f"http.cookie_{name}", "set-cookie", "warning", COOKIE_TEXTS[name][0],
                 F.lit(COOKIE_TEXTS[name][1])) for name, test in tests.items()]


def hsts_hits() -> list[Column]:
    hsts = header("strict-transport-security")
    age = F.nullif(F.regexp_extract(hsts, r"max-age=(\d+)", 1), F.lit(""))
    detail = F.concat(F.lit("Aktuel: "), hsts)
    # more than 18 digits is certainly long enough and would not fit a long
    short = (F.length(age) <= 18) & (age.try_cast("long") < HSTS_MIN_AGE)
    text = F.concat(F.lit("HSTS max-age er kun "), age.try_cast("long").cast("string"),
                    F.lit("s – anbefalet minimum er 31536000 (1 år)"))
    name = "strict-transport-security"
    return [_hit(short, "http.hsts_age", name, "info", text, detail),
            _hit((hsts != "") & ~hsts.contains("includeSubDomains"), "http.hsts_subdomains", name, "info",
                 HSTS_NO_SUBDOMAINS, detail)]


def cors_hits() -> list[Column]:
    origin, credentials = header("access-control-allow-origin"), header("access-control-allow-credentials")
    return [_hit((origin == "*") & (F.lower(credentials) == "true"), "http.cors_credentials",
                 "access-control-allow-credentials", "warning", CORS_CREDENTIALS,
                 F.concat(F.lit("Origin: "), origin, F.lit(", Credentials: "), credentials))]


def header_presence(responses: DataFrame) -> DataFrame:
    """Headers that must be there, must not be there, or must hold a value (HD-1)."""
    return _findings(responses, presence_hits())


def csp_content(responses: DataFrame) -> DataFrame:
    """Weak content-security policies (HD-2)."""
    return _findings(responses, csp_hits())


def cookie_flags(responses: DataFrame) -> DataFrame:
    """Cookies without their protective attributes (HD-3)."""
    return _findings(responses, cookie_hits())


def hsts_strength(responses: DataFrame) -> DataFrame:
    """Short or partial transport security (HD-4)."""
    return _findings(responses, hsts_hits())


def cors_credentials(responses: DataFrame) -> DataFrame:
    """Any origin together with credentials (HD-5)."""
    return _findings(responses, cors_hits())


def header_findings(responses: DataFrame) -> DataFrame:
    """HD-1 to HD-5 in one projection."""
    return _findings(responses, presence_hits() + csp_hits() + cookie_hits() + hsts_hits() + cors_hits())


def service_fingerprint(responses: DataFrame) -> DataFrame:
    """``project_id, url, service, via``: hosting services that header names give away (HD-6)."""
    found = F.filter(F.array(*[
        F.when(F.map_contains_key("headers", name),
               F.struct(F.lit(service).alias("service"), F.lit(f"header: {name}").alias("via")))
        for service, name in FINGERPRINTS]), lambda s: s.isNotNull())
    return each(responses, found, "s", "project_id", "url").select("project_id", "url", "s.*")


def posture_summary(responses: DataFrame) -> DataFrame:
    """Share of a host's responses with a finding, per header (FL-2).

    Counts are combined per task before the shuffle; hosts without a finding keep a rate of zero.
    """
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)
    hits = presence_hits() + csp_hits() + cookie_hits() + hsts_hits() + cors_hits()
    names = F.array_distinct(F.transform(F.filter(F.array(*hits), lambda h: h.isNotNull()), lambda h: h["header"]))
    per_response = responses.select(host.alias("host"), names.alias("_bad"))
    checked = sorted({n for n, *_ in HEADER_RULES} | {"set-cookie", "access-control-allow-credentials"})
    counts = per_response.groupBy("host").agg(
        F.count(F.lit(1)).alias("responses"),
        *[F.count_if(F.array_contains("_bad", n)).alias(n) for n in checked])
    pairs = F.array(*[F.struct(F.lit(n).alias("header"), F.col(f"`{n}`").alias("n")) for n in checked])
    return (counts.select("host", "responses", F.explode(pairs).alias("p"))
            .select("host", F.col("p.header").alias("header"), "responses", F.col("p.n").alias("bad_responses"),
                    F.round(F.col("p.n") / F.col("responses"), 6).alias("finding_rate")))
