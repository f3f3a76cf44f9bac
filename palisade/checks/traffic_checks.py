"""Cross-checks of browser traffic, page fragments and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.checks.fixtures import scratch
from palisade.checks.registry import check
from palisade.checks.sql import BLOCKS, in_list, lit, match, rules_table, with_
from palisade.operators import traffic as tr
from palisade.operators.credentials import credential_dedup, credential_inventory
from palisade.operators.env_scan import env_values, last_env_value
from palisade.operators.probes import table_references, tables_to_probe
from palisade.rules.secrets import (
    API_CALL_LABELS, COMMON_VALUES, CREDENTIALS_IN_URL, CRITICAL_NAME_WORDS, MODE_VARIABLES, TRAFFIC_SECRETS,
)
from palisade.sources.captures import read_traffic
from palisade.sources.files import projects_of
from palisade.streaming import traffic as streams

_CRITICAL = " OR ".join(f"contains(upper(key), '{w}')" for w in CRITICAL_NAME_WORDS)
_SCANNABLE = "regexp_matches(content_type, 'json|javascript|text/')"
_WHERE = "concat('[', method, ' ', url, ']')"
BLOCKS["patterns"] = (("last_values",), f"""SELECT project_id, value, key, source, CASE WHEN {_CRITICAL} THEN 'critical' ELSE 'warning' END AS severity
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id, value ORDER BY first_seen, key) AS r FROM last_values
          WHERE upper(key) NOT IN {in_list(MODE_VARIABLES)} AND lower(value) NOT IN {in_list(COMMON_VALUES)} AND length(value) >= 16)
    WHERE r = 1 AND (NOT contains(upper(key), 'URL') OR regexp_matches(value, {lit(CREDENTIALS_IN_URL)}))""")
BLOCKS["texts"] = (("fx_traffic",), f"""SELECT * FROM (
    SELECT project_id, request_id AS text_id, 'header' AS kind, concat('request-header ', {_WHERE}) AS source, replace(header_block, chr(10), ' ') AS text FROM fx_traffic
    UNION ALL SELECT project_id, request_id, 'url', concat('request-url ', {_WHERE}), url FROM fx_traffic
    UNION ALL SELECT project_id, request_id, 'body', concat('response [', url, ']'), body FROM fx_traffic WHERE {_SCANNABLE})
    WHERE text <> ''""")
_ALL = lambda p, g: f"regexp_extract_all(html, {lit(p)}, {g})"
_ATTR = lambda n: (f"coalesce(nullif(regexp_extract(tag, '(?is)\\s{n}\\s*=\\s*\"([^\"]*)\"', 1), ''), "
                   f"nullif(regexp_extract(tag, '(?is)\\s{n}\\s*=\\s*''([^'']*)''', 1), ''))")
_SCRIPT = "(?is)<script([^>]*)>(.*?)</script>"
_STATES = (
    ("window.__NEXT_DATA__", "(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>"),
    ("window.__NUXT_DATA__", r"(?s)window\.__NUXT__\s*=\s*(.*?)\s*;?\s*</script>"),
    ("window.__REMIX_DATA__", r"(?s)window\.__remixContext\s*=\s*(.*?)\s*;?\s*</script>"),
    ("window.ENV/config", r"(?s)window\.(?:ENV|env|config|CONFIG)\s*=\s*(\{.*?\})\s*(?:;|</script>)"),
)
BLOCKS["fragments"] = (("fx_pages",), f"""
    SELECT project_id, page_id AS text_id, 'script' AS kind, concat('inline-script[', row_number() OVER (PARTITION BY page_id ORDER BY i) - 1, ']') AS source, text
    FROM (SELECT project_id, page_id, unnest({_ALL(_SCRIPT, 1)}) AS attrs, unnest({_ALL(_SCRIPT, 2)}) AS text, generate_subscripts({_ALL(_SCRIPT, 2)}, 1) AS i FROM fx_pages)
    WHERE NOT regexp_matches(attrs, '(?i)\\ssrc\\s*=') AND length(text) > 10
    UNION ALL SELECT project_id, page_id, 'meta', concat('meta[', coalesce({_ATTR('name')}, {_ATTR('property')}, '?'), ']'), {_ATTR('content')}
    FROM (SELECT project_id, page_id, unnest({_ALL('(?is)<meta[[:space:]][^>]*>', 0)}) AS tag FROM fx_pages) WHERE {_ATTR('content')} <> ''
    UNION ALL SELECT project_id, page_id, 'data', concat('data-attr[', lower(rtrim(string_split(a, '=')[1])), ']'), regexp_replace(a, '(?s)^[^=]*=\\s*["''](.*)["'']$', '\\1') AS text
    FROM (SELECT project_id, page_id, unnest(regexp_extract_all(tag, '(?is)\\s(data-[a-z0-9_-]+\\s*=\\s*(?:"[^"]*"|''[^'']*''))', 1)) AS a
          FROM (SELECT project_id, page_id, unnest({_ALL('(?is)<[a-z][^>]*[[:space:]]data-(?:key|token|api-key|secret)[[:space:]=>][^>]*>', 0)}) AS tag FROM fx_pages))
    WHERE length(regexp_replace(a, '(?s)^[^=]*=\\s*["''](.*)["'']$', '\\1')) > 0
    UNION ALL """ + " UNION ALL ".join(
    f"SELECT project_id, page_id, 'state', '{n}', regexp_extract(html, {lit(p)}, 1) FROM fx_pages WHERE regexp_extract(html, {lit(p)}, 1) <> ''" for n, p in _STATES))
_HIT_LIST = ", ".join(
    f"CASE WHEN regexp_matches(text, {lit(r.regex)}) THEN list_transform(list_distinct(regexp_extract_all(text, {lit(r.regex)}, 0)), "
    f"lambda m: {{'n': {i}, 'm': m}}) END" for i, r in enumerate(TRAFFIC_SECRETS, 1))


def secrets_sql(texts: str) -> str:
    return f"""SELECT h.project_id, h.text_id, h.source, rl.rule_id, rl.severity, rl.description, sha256(h.hit.m) AS match_hash,
      concat('Fundet i: ', h.source, ' | Mønster: ', substr(h.hit.m, 1, 8), '***') AS detail
      FROM (SELECT project_id, text_id, source, unnest(flatten(list_filter([{_HIT_LIST}], lambda l: l IS NOT NULL))) AS hit FROM {texts} WHERE kind <> 'url') AS h
      JOIN {rules_table(TRAFFIC_SECRETS)} ON rl.n = h.hit.n"""


def exposure_sql(texts: str) -> str:
    return f"""SELECT t.project_id, t.text_id, t.source, p.severity, concat(p.key, ' (fra ', p.source, ') eksponeret i browser') AS description,
      concat('Værdi starter med: ', substr(p.value, 1, 8), '*** | Fundet i: ', t.source) AS detail, p.key AS env_var, p.source AS env_source
      FROM {texts} AS t JOIN patterns AS p ON p.project_id = t.project_id AND contains(t.text, p.value)"""


BLOCKS["all_texts"] = (("texts", "fragments"), "SELECT project_id, text_id, kind, source, text FROM texts UNION ALL SELECT project_id, text_id, kind, source, text FROM fragments")
BLOCKS["exposures"] = (("all_texts", "patterns"), f"""
    SELECT project_id, text_id, source, rule_id, severity, description, detail, match_hash, NULL AS env_var, NULL AS env_source, false AS dynamic_match FROM ({secrets_sql('all_texts')})
    UNION ALL SELECT project_id, text_id, source, 'exposure.env_value', severity, description, detail, NULL, env_var, env_source, true FROM ({exposure_sql('all_texts')})""")
DEDUP_SQL = """SELECT project_id, source, rule_id, severity, description, detail, env_var, env_source, dynamic_match FROM (SELECT *, row_number() OVER (PARTITION BY project_id,
      dynamic_match, CASE WHEN dynamic_match THEN env_var ELSE description END, source, match_hash
      ORDER BY text_id, source, detail) AS r FROM exposures) WHERE r = 1"""
_SECRET_COLS = ("project_id", "text_id", "source", "rule_id", "severity", "description", "match_hash", "detail")
_EXPOSED_COLS = ("project_id", "text_id", "source", "severity", "description", "detail", "env_var", "env_source")


def patterns_of(inp) -> DataFrame:
    return tr.eligible_env_values(last_env_value(env_values(inp.files)))


@check("src6_traffic", with_("fx_traffic", select="""SELECT project_id, request_id, method, url, resource_type, content_type, body_bytes, md5(body) AS body_md5,
    replace(header_block, chr(10), ' ') AS header_text FROM fx_traffic"""))
def _(inp):
    text = F.array_join(F.transform(F.map_entries("request_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " ")
    return inp.traffic.select("project_id", "request_id", "method", "url", "resource_type", "content_type", "body_bytes",
                              F.md5("body").alias("body_md5"), text.alias("header_text"))


@check("pf5_eligible_env_values", with_("patterns", select="SELECT project_id, value, key, source, severity FROM patterns"))
def _(inp):
    return patterns_of(inp)


@check("pf6_scannable_bodies", with_("fx_traffic", select=f"SELECT project_id, request_id, content_type, body_bytes FROM fx_traffic WHERE {_SCANNABLE} AND body <> ''"))
def _(inp):
    return tr.scannable_bodies(inp.traffic).select("project_id", "request_id", "content_type", "body_bytes")


@check("pf8_page_fragments", with_("fragments", select="SELECT project_id, text_id, kind, source, md5(text) AS text_md5 FROM fragments"))
def _(inp):
    return tr.page_fragments(inp.pages).select("project_id", "text_id", "kind", "source", F.md5("text").alias("text_md5"))


@check("rs5_scan_text_secrets", with_("all_texts", select=secrets_sql("all_texts")))
def _(inp):
    texts = tr.traffic_texts(inp.traffic).drop("ts").unionByName(tr.page_fragments(inp.pages))
    return tr.scan_text_secrets(texts).select(*_SECRET_COLS)


@check("wd7_fragment_hit_dedup", with_("fragments", select=f"SELECT rule_id, source, count(*) AS hits FROM ({secrets_sql('fragments')}) GROUP BY rule_id, source"))
def _(inp):
    return tr.scan_text_secrets(tr.page_fragments(inp.pages)).groupBy("rule_id", "source").agg(F.count("*").alias("hits"))


_LABEL = "CASE " + " ".join(f"WHEN {match(r.pattern, 'url')} THEN {lit(r.description)}" for r in API_CALL_LABELS) + " END"


@check("rs6_classify_api_calls", with_("fx_traffic", select=f"""SELECT * FROM (SELECT project_id, request_id, method, url, resource_type, {_LABEL} AS label FROM fx_traffic)
    WHERE label IS NOT NULL"""))
def _(inp):
    return tr.classify_api_calls(inp.traffic).drop("ts")


for _name, _broadcast in (("jn2_env_value_exposure", None), ("jn2_env_value_exposure_salted", False)):
    @check(_name, with_("all_texts", "patterns", select=exposure_sql("all_texts")))
    def _(inp, broadcast=_broadcast):
        texts = tr.traffic_texts(inp.traffic).drop("ts").unionByName(tr.page_fragments(inp.pages))
        return tr.env_value_exposure(texts, patterns_of(inp), broadcast).select(*_EXPOSED_COLS)


@check("wd10_exposure_dedup", with_("exposures", select=DEDUP_SQL))
def _(inp):
    return tr.traffic_findings(inp.traffic, patterns_of(inp), inp.pages).select(
        "project_id", "source", "rule_id", "severity", "description", "detail", "env_var", "env_source", "dynamic_match")


@check("ag10_scan_coverage", with_("fx_traffic", "probe_tables", "unique_keys", "patterns", select="""SELECT p.project_id,
    (SELECT count(*) FROM fx_traffic AS t WHERE t.project_id = p.project_id) AS requests,
    (SELECT count(*) FROM probe_tables AS t WHERE t.project_id = p.project_id) AS tables_probed,
    (SELECT count(*) FROM unique_keys AS t WHERE t.project_id = p.project_id) AS keys_tested,
    (SELECT count(*) FROM patterns AS t WHERE t.project_id = p.project_id) AS patterns_used,
    (SELECT count(*) FROM last_values AS t WHERE t.project_id = p.project_id) AS env_variables FROM projects AS p"""))
def _(inp):
    files = inp.files
    env_vars = env_values(files)
    variables = last_env_value(env_vars)
    return tr.scan_coverage(projects_of(files), inp.traffic, tables_to_probe(projects_of(files), table_references(files)),
                            credential_dedup(credential_inventory(env_vars)), tr.eligible_env_values(variables), variables)


@check("ag11_response_summary", with_("texts", "patterns", select=f"""SELECT b.project_id, b.request_id, b.url, b.body_bytes AS size,
    coalesce(s.n, 0) AS secrets_found, coalesce(e.n, 0) AS env_hits FROM (SELECT * FROM fx_traffic WHERE {_SCANNABLE} AND body <> '') AS b
    LEFT JOIN (SELECT text_id, count(*) AS n FROM ({secrets_sql("(SELECT * FROM texts WHERE kind = 'body')")}) GROUP BY text_id) AS s ON s.text_id = b.request_id
    LEFT JOIN (SELECT text_id, count(*) AS n FROM ({exposure_sql("(SELECT * FROM texts WHERE kind = 'body')")}) GROUP BY text_id) AS e ON e.text_id = b.request_id"""))
def _(inp):
    return tr.response_summary(inp.traffic, patterns_of(inp))


@check("tk1_top_api_calls", with_("fx_traffic", select=f"""SELECT project_id, rank, method, url, label FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, request_id) AS rank FROM (SELECT *, {_LABEL} AS label FROM fx_traffic) WHERE label IS NOT NULL)
    WHERE rank <= 10"""))
def _(inp):
    return tr.top_api_calls(tr.classify_api_calls(inp.traffic))


@check("tk1_top_key_labels", with_("unique_keys", select="""SELECT project_id, rank, concat(var, ' (role: ', role, ', jwt: ', CASE WHEN is_jwt THEN 'True' ELSE 'False' END, ')') AS label
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY first_rank, source, line) AS rank FROM unique_keys) WHERE rank <= 5"""))
def _(inp):
    return tr.top_key_labels(credential_dedup(credential_inventory(env_values(inp.files))))


# ------------------------------------------------------------------ streams


def through_stream(inp, job) -> DataFrame:
    """Write the traffic as files, run ``job`` over them as a stream to its end, and read what it wrote."""
    folder = scratch(inp.spark)
    files = 4 * max(1, inp.spark.sparkContext.defaultParallelism // 2)  # two batches, each with work for all cores
    inp.traffic.repartitionByRange(files, "ts").write.parquet(f"{folder}/in")
    arriving = read_traffic(inp.spark, f"{folder}/in", streaming=True, max_files=files // 2)
    query = (job(arriving).writeStream.format("parquet").option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return inp.spark.read.parquet(f"{folder}/out")


@check("st1_stream_secret_scan", with_("texts", select=f"SELECT * FROM ({secrets_sql('texts')})"))
def _(inp):
    return through_stream(inp, streams.stream_secret_scan).select(*_SECRET_COLS)


@check("st2_stream_env_exposure", with_("texts", "patterns", select=exposure_sql("texts")))
def _(inp):
    return through_stream(inp, lambda t: streams.stream_env_exposure(t, patterns_of(inp))).select(*_EXPOSED_COLS)


@check("st2_stream_env_exposure_shuffled", with_("texts", "patterns", select=exposure_sql("texts")))
def _(inp):
    return through_stream(inp, lambda t: streams.stream_env_exposure(t, patterns_of(inp), broadcast=False)).select(*_EXPOSED_COLS)


BLOCKS["stream_exposures"] = (("texts", "patterns"), f"""
    SELECT project_id, source, description, match_hash, NULL AS env_var, false AS dynamic_match FROM ({secrets_sql('texts')})
    UNION ALL SELECT project_id, source, description, NULL, env_var, true FROM ({exposure_sql('texts')})""")


@check("st3_stream_exposure_dedup", with_("stream_exposures", select="""SELECT DISTINCT project_id, dynamic_match,
      CASE WHEN dynamic_match THEN env_var ELSE description END AS what, source AS place, match_hash
      FROM stream_exposures"""))
def _(inp):
    # a watermark longer than the capture keeps every key, so the stream must equal the batch
    job = lambda t: streams.stream_exposure_dedup(streams.stream_exposures(t, patterns_of(inp)), "60 days")
    dynamic = F.col("dynamic_match")
    return through_stream(inp, job).select(
        "project_id", "dynamic_match", F.when(dynamic, F.col("env_var")).otherwise(F.col("description")).alias("what"),
        F.col("source").alias("place"), "match_hash")
