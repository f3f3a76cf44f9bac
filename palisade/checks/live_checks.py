"""Cross-checks of responses, datastores, credentials and access probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.checks.fixtures import scratch, values_sql
from palisade.checks.registry import check
from palisade.checks.sql import BLOCKS, SPACES, lines_of, lit, profile, strip, with_
from palisade.operators import credentials as cred
from palisade.operators import datastores as ds
from palisade.operators import http_posture as http
from palisade.operators import probes
from palisade.operators.env_scan import env_values
from palisade.rules.datastores import (
    AUTH_COMBOS, BODY_TYPE_PATTERNS, CRITICAL_TABLES, DIALECT_PATTERN, HEADER_TYPES, HINT_KEYS, HINTS, KEY_NAME_PATTERNS,
    ORM_PROVIDER_PATTERN, ORM_PROVIDERS, ORM_URL_ENV_PATTERN, ORM_URL_PATTERN, QUERY_CALL_PATTERNS, VALUE_PATTERNS,
)
from palisade.rules.secrets import JWT_PAYLOAD, URL_VALUE, URL_VALUE_OF_KEY_LAYER
from palisade.rules.web import (
    COOKIE_TEXTS, CORS_CREDENTIALS, CSP_RULES, FINGERPRINTS, HEADER_RULES, HSTS_NO_SUBDOMAINS,
)
from palisade.sources.captures import read_access_probes, read_responses
from palisade.sources.files import projects_of

# ------------------------------------------------------------------ response headers

# one row per response and header name; of repeated names the last counts
BLOCKS["header_rows"] = (("fx_responses",), """
    SELECT project_id, url, lower(trim(substr(h, 1, instr(h, ':') - 1))) AS name, arg_max(trim(substr(h, instr(h, ':') + 1)), i) AS value
    FROM (SELECT project_id, url, unnest(string_split(headers, chr(10))) AS h, generate_subscripts(string_split(headers, chr(10)), 1) AS i FROM fx_responses)
    WHERE instr(h, ':') > 0 GROUP BY project_id, url, lower(trim(substr(h, 1, instr(h, ':') - 1)))""")
_NAMES = sorted({h[0] for h in HEADER_RULES} | {"set-cookie", "access-control-allow-credentials"})
# the same as one column per header that a rule reads
BLOCKS["heads"] = (("header_rows",), "SELECT r.project_id, r.url, " + ", ".join(
    f"max(CASE WHEN h.name = '{n}' THEN h.value END) AS \"{n}\"" for n in _NAMES) +
    " FROM fx_responses AS r LEFT JOIN header_rows AS h ON h.project_id = r.project_id AND h.url = r.url GROUP BY r.project_id, r.url")


def _rows(rule_id: str, name: str, severity: str, text: str, detail: str, where: str) -> str:
    return (f"SELECT project_id, url AS source, '{rule_id}' AS rule_id, '{name}' AS header, '{severity}' AS severity, "
            f"{text} AS description, {detail} AS detail FROM heads WHERE {where}")


def _presence() -> str:
    parts = []
    for i, (name, kind, text, severity) in enumerate(HEADER_RULES, 1):
        v = f'"{name}"'
        where = {"present": f"{v} IS NULL", "absent": f"{v} IS NOT NULL",
                 "nosniff": f"{v} IS NULL OR NOT contains(lower({v}), 'nosniff')",
                 "not_wildcard": f"{v} IS NOT NULL AND trim({v}, {SPACES}) = '*'"}[kind]
        detail = f"CASE WHEN {v} <> '' THEN concat('Aktuel værdi: ', {v}) ELSE 'Header ikke tilstede' END"
        parts.append(_rows(f"http.header_{i:02d}", name, severity, lit(text), detail, where))
    return " UNION ALL ".join(parts)


_CSP = " UNION ALL ".join(
    _rows(f"http.csp_{i}", "content-security-policy", sev, lit(text), 'concat(\'CSP: \', substr("content-security-policy", 1, 120))',
          f'regexp_matches("content-security-policy", {lit(p)})') for i, (p, text, sev) in enumerate(CSP_RULES, 1))
_C = 'lower("set-cookie")'
_COOKIE_TESTS = {
    "httponly": f"NOT contains({_C}, 'httponly')", "secure": f"NOT contains({_C}, 'secure')",
    "samesite": f"NOT contains({_C}, 'samesite')", "none_insecure": f"contains({_C}, 'samesite=none') AND NOT contains({_C}, 'secure')",
}
_COOKIES = " UNION ALL ".join(
    _rows(f"http.cookie_{n}", "set-cookie", "warning", lit(COOKIE_TEXTS[n][0]), lit(COOKIE_TEXTS[n][1]),
          f"{_C} <> '' AND {test}") for n, test in _COOKIE_TESTS.items())
_H = '"strict-transport-security"'
_AGE = f"TRY_CAST(regexp_extract({_H}, 'max-age=(\\d+)', 1) AS BIGINT)"
_HSTS = (_rows("http.hsts_age", "strict-transport-security", "info",
               f"concat('HSTS max-age er kun ', {_AGE}, 's – anbefalet minimum er 31536000 (1 år)')", f"concat('Aktuel: ', {_H})",
               f"{_AGE} < 31536000") + " UNION ALL " +
         _rows("http.hsts_subdomains", "strict-transport-security", "info", lit(HSTS_NO_SUBDOMAINS), f"concat('Aktuel: ', {_H})",
               f"{_H} <> '' AND NOT contains({_H}, 'includeSubDomains')"))
_O, _K = '"access-control-allow-origin"', '"access-control-allow-credentials"'
_CORS = _rows("http.cors_credentials", "access-control-allow-credentials", "warning", lit(CORS_CREDENTIALS),
              f"concat('Origin: ', {_O}, ', Credentials: ', {_K})", f"{_O} = '*' AND lower({_K}) = 'true'")
_ALL_HTTP = " UNION ALL ".join((_presence(), _CSP, _COOKIES, _HSTS, _CORS))
_COLS = ("project_id", "source", "rule_id", "header", "severity", "description", "detail")

for _name, _job, _sql in (
    ("hd1_header_presence", http.header_presence, _presence()), ("hd2_csp_content", http.csp_content, _CSP),
    ("hd3_cookie_flags", http.cookie_flags, _COOKIES), ("hd4_hsts_strength", http.hsts_strength, _HSTS),
    ("hd5_cors_credentials", http.cors_credentials, _CORS), ("hd_all_header_findings", http.header_findings, _ALL_HTTP),
):
    check(_name, with_("heads", select=_sql))(lambda inp, job=_job: job(inp.responses).select(*_COLS))


_HEADER_ROWS = with_("header_rows", select="SELECT project_id, url, name, value FROM header_rows")


@check("src5_responses", _HEADER_ROWS)
def _(inp):
    """Header blocks, as the reader finds them in files."""
    folder = f"{scratch(inp.spark)}/responses"
    inp.raw_responses.write.parquet(folder)
    return read_responses(inp.spark, folder).select("project_id", "url", F.explode("headers").alias("name", "value"))


@check("src5_responses_as_maps", _HEADER_ROWS)
def _(inp):
    """Headers as maps, their names in mixed case and repeated in another case, read as JSON with a schema."""
    folder = f"{scratch(inp.spark)}/responses"
    pairs = F.transform(F.map_entries("headers"), lambda e: F.struct(F.initcap(e["key"]).alias("key"), e["value"].alias("value")))
    stale = F.transform(F.map_entries("headers"), lambda e: F.struct(F.upper(e["key"]).alias("key"), F.lit("stale").alias("value")))
    mixed = F.map_from_entries(F.concat(F.filter(stale, lambda e: e["key"] != F.initcap(e["key"])), pairs))
    inp.responses.withColumn("headers", mixed).write.json(folder)
    schema = "project_id string, url string, status int, headers map<string,string>, body string"
    return read_responses(inp.spark, folder, "json", schema).select("project_id", "url", F.explode("headers").alias("name", "value"))


@check("hd6_service_fingerprint", with_("header_rows", select=f"""SELECT project_id, url, service, concat('header: ', h.name) AS via
    FROM header_rows AS h JOIN {values_sql(FINGERPRINTS, 's', 'service', 'name')} ON s.name = h.name"""))
def _(inp):
    return http.service_fingerprint(inp.responses)


_HOST = "regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)"


@check("fl2_posture_summary", with_("heads", select=f"""
    SELECT t.host, n.header, t.responses, count(DISTINCT b.url) AS bad_responses, round(count(DISTINCT b.url) / t.responses, 6) AS finding_rate
    FROM (SELECT {_HOST} AS host, count(*) AS responses FROM fx_responses GROUP BY 1) AS t
    CROSS JOIN {values_sql([(n,) for n in _NAMES], 'n', 'header')}
    LEFT JOIN (SELECT {_HOST.replace('url', 'source')} AS host, source AS url, header FROM ({_ALL_HTTP})) AS b ON b.host = t.host AND b.header = n.header
    GROUP BY t.host, n.header, t.responses"""))
def _(inp):
    return http.posture_summary(inp.responses)


# ------------------------------------------------------------------ datastores

_T = strip("text")
_V = "trim(trim(" + strip("substr(t, instr(t, '=') + 1)") + ", '\"'), chr(39))"
_TECH = "CASE " + " ".join(f"WHEN regexp_matches(key, {lit(p)}) THEN '{t}'" for p, t in KEY_NAME_PATTERNS) + " END"
BLOCKS["named_keys"] = (("fx_files",), f"""SELECT * FROM (SELECT *, {_TECH} AS tech FROM (
    SELECT project_id, path, line, {strip("substr(t, 1, instr(t, '=') - 1)")} AS key, {_V} AS value
    FROM (SELECT *, {_T} AS t FROM ({lines_of('fx_files', where=profile('datastore_names'))}))
    WHERE t <> '' AND NOT starts_with(t, '#') AND contains(t, '='))
    WHERE value <> '' AND NOT starts_with(value, 'your_') AND value <> 'xxx') WHERE tech IS NOT NULL""")
BLOCKS["layer_names"] = (("named_keys",), f"""SELECT project_id, arg_min(tech, (path, line)) AS type, arg_min(key, (path, line)) AS key_env_var,
    arg_min(path, (path, line)) AS key_source,
    arg_min(value, (path, line)) FILTER (WHERE regexp_matches(value, {lit(URL_VALUE_OF_KEY_LAYER)})) AS url,
    arg_min(value, (path, line)) FILTER (WHERE regexp_matches(value, {lit(JWT_PAYLOAD)})) AS anon_key
    FROM named_keys GROUP BY project_id""")
BLOCKS["value_hits"] = (("fx_files",), " UNION ALL ".join(
    f"SELECT project_id, path, {i} AS pattern_no, '{t}' AS type, '{f}' AS field, regexp_extract(content, {lit(p)}, 0) AS value "
    f"FROM fx_files WHERE {profile('datastore')} AND regexp_matches(content, {lit(p)})" for i, (p, t, f) in enumerate(VALUE_PATTERNS, 1)))
BLOCKS["layer_values"] = (("value_hits",), """SELECT project_id, arg_min(type, (path, pattern_no)) AS type,
    arg_min(value, (path, pattern_no)) FILTER (WHERE field NOT IN ('anon_key', 'firebase_api_key')) AS url,
    arg_min(value, (path, pattern_no)) FILTER (WHERE field = 'anon_key') AS anon_key,
    arg_min(value, (path, pattern_no)) FILTER (WHERE field = 'firebase_api_key') AS firebase_api_key FROM value_hits GROUP BY project_id""")
BLOCKS["stores_by_value"] = (("value_hits",), """SELECT project_id, type, 'env-value-scan' AS method, path AS url_source,
    CASE WHEN field NOT IN ('anon_key', 'firebase_api_key') THEN value END AS url,
    CASE WHEN field = 'anon_key' THEN value END AS anon_key, CASE WHEN field = 'firebase_api_key' THEN value END AS firebase_api_key
    FROM (SELECT *, row_number() OVER (PARTITION BY project_id, type ORDER BY path, pattern_no) AS r FROM value_hits) WHERE r = 1""")
_EX = lambda p, g=1: f"nullif(regexp_extract(content, {lit(p)}, {g}), '')"
_KNOWN = "CASE provider " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORM_PROVIDERS.items()) + " ELSE concat('Database (Prisma/', provider, ')') END"
BLOCKS["schemas"] = (("fx_files",), f"""SELECT project_id,
    CASE WHEN prisma THEN {_KNOWN} WHEN {_EX(DIALECT_PATTERN)} IS NOT NULL THEN concat('Database (Drizzle/', {_EX(DIALECT_PATTERN)}, ')')
         ELSE 'Database (Drizzle ORM)' END AS type, prisma, path AS schema_file, provider,
    CASE WHEN prisma THEN {_EX(ORM_URL_ENV_PATTERN)} END AS url_env_var, CASE WHEN prisma THEN {_EX(ORM_URL_PATTERN)} END AS url
    FROM (
            SELECT *, name = 'schema.prisma' AS prisma, CASE WHEN name = 'schema.prisma' THEN lower({_EX(ORM_PROVIDER_PATTERN)}) END AS provider
            FROM fx_files WHERE {profile('schema')})
    WHERE CASE WHEN prisma THEN provider IS NOT NULL ELSE contains(lower(content), 'drizzle') OR contains(lower(content), 'dialect') END""")
BLOCKS["layer_schema"] = (("schemas",), """SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY NOT prisma, schema_file) AS r FROM schemas) WHERE r = 1""")
_B = lambda i: f"nullif(regexp_extract(body, {lit(BODY_TYPE_PATTERNS[i][0])}, 0), '')"
_HAS = lambda h: f"EXISTS (SELECT 1 FROM header_rows AS h WHERE h.project_id = r.project_id AND h.url = r.page_url AND h.name = '{h}')"
BLOCKS["stores_by_response"] = (("header_rows",), f"""SELECT * FROM (SELECT project_id, page_url,
    CASE {' '.join(f"WHEN n = {i} THEN '{t}'" for i, (_, t) in enumerate(BODY_TYPE_PATTERNS))}
         {' '.join(f"WHEN {_HAS(h)} THEN '{t}'" for h, t in HEADER_TYPES)} END AS type,
    CASE {' '.join(f"WHEN n = {i} THEN {_B(i)}" for i in (0, 2, 4, 5, 6, 7, 8))} END AS url,
    {_B(1)} AS anon_key, {_B(3)} AS firebase_api_key, CASE WHEN n = 9 THEN {_B(9)} END AS mongodb_url,
    CASE {' '.join(f"WHEN {_HAS(h)} THEN '{h}'" for h, _ in reversed(HEADER_TYPES))} END AS header_detected
    FROM (SELECT project_id, url AS page_url, body,
            CASE {' '.join(f"WHEN regexp_matches(body, {lit(p)}) THEN {i}" for i, (p, _) in enumerate(BODY_TYPE_PATTERNS))} END AS n FROM fx_responses) AS r)
    WHERE type IS NOT NULL""")
BLOCKS["layer_response"] = (("stores_by_response",), """SELECT * EXCLUDE (r, page_url) FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY page_url) AS r FROM stores_by_response) WHERE r = 1""")
_FIRST = lambda what, test: f"arg_min({what}, (first_rank, source, line)) FILTER (WHERE {test})"
BLOCKS["layer_extracted"] = (("credentials",), f"""SELECT project_id, max(anon_key) AS anon_key, max(anon_key_var) AS anon_key_var,
    max(service_role_key) AS service_role_key, max(service_role_var) AS service_role_var, max(url) AS url, max(url_var) AS url_var FROM (
    SELECT project_id, {_FIRST('token', "role IN ('anon', 'unknown')")} AS anon_key, {_FIRST('var', "role IN ('anon', 'unknown')")} AS anon_key_var,
      {_FIRST('token', "role = 'service_role'")} AS service_role_key, {_FIRST('var', "role = 'service_role'")} AS service_role_var,
      NULL AS url, NULL AS url_var FROM credentials GROUP BY project_id
    UNION ALL SELECT project_id, NULL, NULL, NULL, NULL, arg_min(value, (first_rank, source, line)), arg_min(key, (first_rank, source, line))
      FROM env_vars WHERE regexp_matches(value, {lit(URL_VALUE)}) GROUP BY project_id) GROUP BY project_id""")
BLOCKS["stores"] = (("stores_by_value", "schemas", "stores_by_response"), """SELECT * EXCLUDE (r, rank, place) FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, type ORDER BY rank, place) AS r FROM (
      SELECT project_id, type, 'header-first' AS method, url, anon_key, firebase_api_key, NULL AS schema_file, NULL AS prisma, NULL AS provider,
             NULL AS url_env_var, 0 AS rank, page_url AS place FROM stores_by_response
      UNION ALL SELECT project_id, type, 'prisma-schema', url, NULL, NULL, schema_file, prisma, provider, url_env_var, 1, schema_file FROM schemas
      UNION ALL SELECT project_id, type, 'env-value-scan', url, anon_key, firebase_api_key, NULL, NULL, NULL, NULL, 2, url_source FROM stores_by_value)) WHERE r = 1""")


@check("jn6_datastore_by_key_name", with_("layer_names", select="SELECT * FROM layer_names"))
def _(inp):
    return ds.datastore_by_key_name(inp.files)


@check("jn7_datastore_by_value", with_("stores_by_value", select="SELECT * FROM stores_by_value"))
def _(inp):
    return ds.datastore_by_value(inp.files)


@check("wd9_first_per_technology", with_("value_hits", select="""
    SELECT project_id, type, path, pattern_no FROM (SELECT *, row_number() OVER (PARTITION BY project_id, type ORDER BY path, pattern_no) AS r FROM value_hits) WHERE r = 1"""))
def _(inp):
    hits = ds.value_hits(inp.files)
    return ds.first_per_technology(hits.select("project_id", "type", "path", "pattern_no", F.struct("path", "pattern_no").alias("_order")))


@check("jn8_datastore_by_schema", with_("layer_schema", select="SELECT project_id, type, prisma, schema_file, provider, url_env_var, url FROM layer_schema"))
def _(inp):
    return ds.datastore_by_schema(inp.files)


@check("jn9_datastore_by_response", with_("stores_by_response", select="SELECT * FROM stores_by_response"))
def _(inp):
    return ds.datastore_by_response(inp.responses)


@check("ag6_datastore_list", with_("stores", select="SELECT * FROM stores"))
def _(inp):
    return ds.datastore_list(inp.files, inp.responses)


_P = """SELECT coalesce(r.project_id, s.project_id, n.project_id, v.project_id, x.project_id) AS project_id,
    r.type IS NOT NULL AS answered, r.type IS NOT NULL OR s.type IS NOT NULL AS declared,
    r.type AS r_type, s.type AS s_type, n.type AS n_type, v.type AS v_type, r.url AS r_url, s.url AS s_url, n.url AS n_url, v.url AS v_url, x.url AS x_url,
    r.anon_key AS r_key, n.anon_key AS n_key, v.anon_key AS v_key, x.anon_key AS x_key, x.url_var, x.anon_key_var, x.service_role_key, x.service_role_var,
    coalesce(r.firebase_api_key, v.firebase_api_key) AS firebase_api_key, r.mongodb_url, r.header_detected, n.key_env_var, n.key_source,
    s.prisma, s.schema_file, s.provider, s.url_env_var
    FROM layer_response AS r FULL JOIN layer_schema AS s ON r.project_id = s.project_id
    FULL JOIN layer_names AS n ON n.project_id = coalesce(r.project_id, s.project_id)
    FULL JOIN layer_values AS v ON v.project_id = coalesce(r.project_id, s.project_id, n.project_id)
    FULL JOIN layer_extracted AS x ON x.project_id = coalesce(r.project_id, s.project_id, n.project_id, v.project_id)"""
_URL = "coalesce(r_url, CASE WHEN NOT answered THEN s_url END, CASE WHEN NOT declared THEN n_url END, v_url)"
_KEY = "coalesce(r_key, CASE WHEN NOT declared THEN n_key END, v_key)"


_MASKED = lambda c: f"substr({c}, 1, 8) || '***'"
_BARE = lambda c: f"regexp_replace({c}, '://[^/@\\s]*@', '://***@')"
PROFILE_BLOCKS = ("layer_response", "layer_schema", "layer_names", "layer_values", "layer_extracted", ("p", _P))
PROFILE_SQL = f"""    SELECT project_id, coalesce(r_type, s_type, n_type, v_type, CASE WHEN x_key IS NOT NULL OR x_url IS NOT NULL THEN 'Supabase' END) AS type,
      CASE WHEN r_type IS NOT NULL THEN 'header-first' WHEN s_type IS NOT NULL THEN 'prisma-schema' WHEN n_type IS NOT NULL THEN 'env-key-name'
           WHEN v_type IS NOT NULL THEN 'env-value-scan' END AS method,
      {_BARE(f'coalesce({_URL}, x_url)')} AS url, CASE WHEN {_URL} IS NULL THEN url_var END AS url_var,
      {_MASKED(f'coalesce({_KEY}, x_key)')} AS anon_key, sha256(coalesce({_KEY}, x_key)) AS anon_key_hash, CASE WHEN {_KEY} IS NULL THEN anon_key_var END AS anon_key_var,
      {_MASKED('service_role_key')} AS service_role_key, sha256(service_role_key) AS service_role_key_hash, service_role_var,
      {_MASKED('firebase_api_key')} AS firebase_api_key, sha256(firebase_api_key) AS firebase_api_key_hash, {_BARE('mongodb_url')} AS mongodb_url, header_detected,
      CASE WHEN NOT declared THEN key_env_var END AS key_env_var, CASE WHEN NOT declared THEN key_source END AS key_source,
      prisma, schema_file, provider, CASE WHEN NOT answered THEN url_env_var END AS url_env_var FROM p"""


@check("ag5_datastore_profile", with_(*PROFILE_BLOCKS, select=PROFILE_SQL))
def _(inp):
    return ds.datastore_profile(inp.files, inp.responses)


_HKEY = "CASE " + " ".join(f"WHEN contains(lower(type), '{k.lower()}') THEN '{k}'" for k in HINT_KEYS) + " END"
HINTS_SQL = f"""SELECT project_id, h.severity, h.text AS description, h.detail FROM (SELECT *, {_HKEY} AS k FROM stores) AS s
    JOIN {values_sql(HINTS, 'h', 'k', 'severity', 'text', 'detail')} ON h.k = s.k
    UNION ALL SELECT project_id, 'info', concat('Prisma bruger env var ', chr(39), url_env_var, chr(39), ' til database URL'),
      'Sørg for at denne variabel aldrig commites til git' FROM stores WHERE prisma AND url_env_var IS NOT NULL
    UNION ALL SELECT project_id, 'warning', 'Prisma med SQLite – ikke egnet til produktionsbrug',
      'Skift til PostgreSQL, MySQL eller andet produktionssystem' FROM stores WHERE prisma AND provider = 'sqlite'"""
EXPOSED_SQL = """SELECT project_id, 'warning' AS severity, concat('Supabase anon-nøgle eksponeret i ', CASE method WHEN 'header-first' THEN 'klient-HTML' ELSE 'fil' END) AS description,
      concat('Nøgle: ', substr(anon_key, 1, 30), '...') AS detail FROM stores WHERE anon_key IS NOT NULL
    UNION ALL SELECT project_id, 'warning', 'Firebase API-nøgle fundet i klientkode', concat('Key: ', substr(firebase_api_key, 1, 20), '...')
      FROM stores WHERE firebase_api_key IS NOT NULL"""


@check("jn10_datastore_hints", with_("stores", select=HINTS_SQL))
def _(inp):
    return ds.datastore_hints(ds.datastore_list(inp.files, inp.responses)).select("project_id", "severity", "description", "detail")


@check("jn18_client_key_exposure", with_("stores", select=EXPOSED_SQL))
def _(inp):
    return ds.client_key_exposure(ds.datastore_list(inp.files, inp.responses)).select("project_id", "severity", "description", "detail")


# ------------------------------------------------------------------ credentials and probes


@check("ag7_credential_inventory", with_("credentials", select="SELECT project_id, var, token, role, is_jwt, source, line FROM credentials"))
def _(inp):
    return cred.credential_inventory(env_values(inp.files)).drop("first_rank")


@check("wd4_credential_dedup", with_("unique_keys", select="SELECT project_id, var, token, role, is_jwt, source FROM unique_keys"))
def _(inp):
    return cred.credential_dedup(cred.credential_inventory(env_values(inp.files))).drop("first_rank", "line")


@check("ag8_credential_summary", with_("layer_extracted", select="""SELECT project_id, anon_key, anon_key_var, service_role_key, service_role_var, url, url_var
    FROM layer_extracted"""))
def _(inp):
    return cred.credential_summary(env_values(inp.files))


_CALLS = " UNION ALL ".join(f"SELECT project_id, unnest(regexp_extract_all(content, {lit(p)}, {g})) AS n FROM fx_files WHERE {profile('query_code')}"
                            for p, g in QUERY_CALL_PATTERNS)
BLOCKS["table_refs"] = (("fx_files",), f"SELECT DISTINCT project_id, lower(n) AS table_name FROM ({_CALLS}) WHERE length(n) > 1 AND NOT starts_with(n, '_')")
BLOCKS["probe_tables"] = (("table_refs", "projects"), f"""SELECT project_id, table_name FROM table_refs
    UNION SELECT project_id, t.n FROM projects CROSS JOIN {values_sql([(t,) for t in CRITICAL_TABLES], 't', 'n')}""")
_COMBO = values_sql(list(enumerate(AUTH_COMBOS)), "c", "combo_order", "combo")
BLOCKS["open_cells"] = (("fx_probes", "probe_tables", "unique_keys"), f"""
    SELECT p.project_id, p.table_name, p.key_var, k.role AS key_role, k.is_jwt, c.combo, c.combo_order, p.rows_returned
    FROM fx_probes AS p JOIN {_COMBO} ON c.combo = p.combo JOIN probe_tables AS t ON t.project_id = p.project_id AND t.table_name = p.table_name
    JOIN unique_keys AS k ON k.project_id = p.project_id AND k.var = p.key_var WHERE p.status = 200 AND p.rows_returned > 0""")


@check("ag9_table_references", with_("table_refs", select="SELECT * FROM table_refs"))
def _(inp):
    return probes.table_references(inp.files)


@check("so2_tables_to_probe", with_("probe_tables", select="SELECT * FROM probe_tables"))
def _(inp):
    files = inp.files
    return probes.tables_to_probe(projects_of(files), probes.table_references(files))


def _grid_inputs(inp):
    files = inp.files
    keys = cred.credential_dedup(cred.credential_inventory(env_values(files)))
    return keys, probes.tables_to_probe(projects_of(files), probes.table_references(files))


@check("jn15_probe_grid", with_("unique_keys", "probe_tables", select=f"""SELECT k.project_id, k.var AS key_var, k.role AS key_role, k.is_jwt, t.table_name, c.combo_order, c.combo
    FROM unique_keys AS k JOIN probe_tables AS t ON t.project_id = k.project_id CROSS JOIN {_COMBO}"""))
def _(inp):
    return probes.probe_grid(*_grid_inputs(inp))


@check("jn15_probe_progress", with_("unique_keys", "probe_tables", "fx_probes", select=f"""
    SELECT t.project_id, t.table_name, 4 * k.n_keys AS n_cells, coalesce(d.n_probed, 0) AS n_probed, 4 * k.n_keys - coalesce(d.n_probed, 0) AS n_left, coalesce(d.n_open, 0) AS n_open
    FROM probe_tables AS t JOIN (SELECT project_id, count(DISTINCT var) AS n_keys FROM unique_keys GROUP BY project_id) AS k ON k.project_id = t.project_id
    LEFT JOIN (SELECT p.project_id, p.table_name, count(DISTINCT (p.key_var, p.combo)) AS n_probed, count(DISTINCT (p.key_var, p.combo)) FILTER (p.status = 200 AND p.rows_returned > 0) AS n_open
        FROM fx_probes AS p JOIN {_COMBO} ON c.combo = p.combo WHERE (p.project_id, p.key_var) IN (SELECT (project_id, var) FROM unique_keys) GROUP BY p.project_id, p.table_name) AS d
      ON d.project_id = t.project_id AND d.table_name = t.table_name"""))
def _(inp):
    return probes.probe_progress(*_grid_inputs(inp), inp.probes)


@check("src7_access_probes", with_("fx_probes", select="""SELECT combo, status, count(*) AS probes, sum(rows_returned) AS total_rows
    FROM fx_probes GROUP BY combo, status"""))
def _(inp):
    folder = f"{scratch(inp.spark)}/probes"
    inp.probes.withColumn("note", F.lit("not read")).write.parquet(folder)
    return read_access_probes(inp.spark, folder).groupBy("combo", "status").agg(F.count("*").alias("probes"), F.sum("rows_returned").alias("total_rows"))


def open_sql(direction: str) -> str:
    kind = "CASE WHEN is_jwt THEN 'JWT' ELSE 'API-nøgle' END"
    return f"""SELECT project_id, table_name, key_var, key_role, combo AS auth_combo, rows_returned, 'critical' AS severity,
      CASE WHEN combo = 'no-auth' THEN concat('🚨 TABEL ', chr(39), table_name, chr(39), ' ÅBEN UDEN AUTH – ingen nøgle påkrævet!')
           WHEN key_role = 'service_role' THEN concat('🚨 SERVICE_ROLE KEY (', key_var, ') kan læse ', chr(39), table_name, chr(39), ' – denne nøgle er ALDRIG sikker i frontend/klient-kode')
           ELSE concat('RLS MANGLER på ', chr(39), table_name, chr(39), ' – data tilgængeligt via ', key_var, ' (role: ', key_role, ', type: ', {kind}, ')') END AS description,
      CASE WHEN combo = 'no-auth' THEN concat('Tabellen returnerer ', rows_returned, ' rækker UDEN nogen form for autentificering. Alle på internettet kan læse data. Aktiver RLS STRAKS.')
           WHEN key_role = 'service_role' THEN concat('service_role (', key_var, ') via [', combo, '] returnerer ', rows_returned, ' rækker fra /', table_name,
             '. service_role omgår RLS og hører UDELUKKENDE i server-side kode.')
           ELSE concat(key_var, ' via [', combo, '] returnerer ', rows_returned, ' rækker fra /', table_name,
             '. Aktiver RLS i Supabase Dashboard → Authentication → Policies.') END AS detail
      FROM (SELECT *, row_number() OVER (PARTITION BY project_id, table_name, key_var, key_role, is_jwt ORDER BY combo_order {direction}, rows_returned DESC) AS r FROM open_cells) WHERE r = 1"""


for _mode, _dir in (("first", "ASC"), ("weakest", "DESC")):
    check(f"jn16_open_tables_{_mode}", with_("open_cells", select=open_sql(_dir)))(
        lambda inp, mode=_mode: probes.open_table_findings(*_grid_inputs(inp), inp.probes, mode).select(
            "project_id", "table_name", "key_var", "key_role", "auth_combo", "rows_returned", "severity", "description", "detail"))
