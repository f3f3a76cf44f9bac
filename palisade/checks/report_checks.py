"""Cross-checks of free-text scans, scores, guidance, briefs and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.checks.fixtures import scratch, values_sql
from palisade.checks.live_checks import _ALL_HTTP, EXPOSED_SQL, HINTS_SQL, PROFILE_BLOCKS, PROFILE_SQL, open_sql
from palisade.checks.registry import check
from palisade.checks.traffic_checks import DEDUP_SQL
from palisade.checks.sql import BLOCKS, first_rule, lines_of, lit, match, rules_table, strip, with_
from palisade.checks.static_checks import (
    CODE_LINES, COMMIT_BLOCKS, COMMIT_SQL, DEPS, ENV_FINDINGS_SQL, IGNORE_BLOCKS, IGNORE_SQL, LEAKS_SQL, LITERAL_LINES, STACKS,
    TEMPLATE_SQL, TRACKED, TRACKED_SQL, VAULT_SQL, _shown, code_findings_sql, code_hits_sql,
)
from palisade.operators import code_scan, report, scoring, stacks
from palisade.plans import corpus
from palisade.plans.fleet import Fleet, fleet_findings, fleet_report
from palisade.rules.code import CODE_RULES
from palisade.rules.guidance import (
    ENV_FILE_EXPLANATION, ENV_FILE_REMEDY, ENV_FILE_TITLE, ENV_FILE_WORDS, GUIDANCE, SECTION_TITLES, VERDICTS,
)
from palisade.rules.secrets import ENV_FORMATS, TRAFFIC_SECRETS
from palisade.sources.files import projects_of
from palisade.sources.sinks import read_findings, write_findings, write_report

# ------------------------------------------------------------------ secrets in free text


def _masked() -> str:
    masked = strip("text")
    for r in ENV_FORMATS + TRAFFIC_SECRETS:
        pattern, into = r.regex, "***"
        if r.rule_id == "env_format.aws_secret_40":
            pattern, into = "(^|[^A-Za-z0-9/+])[A-Za-z0-9/+]{40}([^A-Za-z0-9/+]|$)", "\\1***\\2"
        masked = f"regexp_replace({masked}, {lit(pattern)}, '{into}', 'g')"
    return f"substr({masked}, 1, 120)"


def _texts(name: str, sql: str) -> None:
    BLOCKS[f"{name}_lines"] = ((), lines_of(f"({sql})", keep="project_id, file"))
    tests = ", ".join(f"CASE WHEN {match(r.pattern, 'text')} THEN {i} END" for i, r in enumerate(TRAFFIC_SECRETS, 1))
    BLOCKS[f"{name}_hits"] = ((f"{name}_lines",), f"""SELECT project_id, file, rule_id, severity, description, min(line) AS line, arg_min(text, line) AS text FROM (
        SELECT h.project_id, h.file, h.line, h.text, rl.rule_id, rl.severity, rl.description
        FROM (SELECT *, {first_rule(ENV_FORMATS, 'text')} AS n FROM {name}_lines) AS h JOIN {rules_table(ENV_FORMATS)} ON rl.n = h.n
        UNION ALL SELECT h.project_id, h.file, h.line, h.text, rl.rule_id, rl.severity, rl.description
        FROM (SELECT *, unnest(list_filter([{tests}], lambda n: n IS NOT NULL)) AS n FROM {name}_lines) AS h JOIN {rules_table(TRAFFIC_SECRETS)} ON rl.n = h.n)
        GROUP BY ALL""")


_texts("doc", "SELECT source AS project_id, concat('doc/', doc_id) AS file, text AS content FROM documents")
_texts("conv", "SELECT concat('conv-', role) AS project_id, concat('conv/', conv_id, '/', turn) AS file, text AS content FROM conversations")
_SHORT = ("project_id", "file", "line", "rule_id", "severity", "description", "detail")


@check("rs7_corpus_documents", with_("doc_hits", select=f"SELECT project_id, file, line, rule_id, severity, description, {_masked()} AS detail FROM doc_hits"))
def _(inp):
    return corpus.corpus_secret_scan(corpus.documents_as_texts(inp.table("documents"))).select(*_SHORT)


#: a turn of every fifth conversation shows a secret-shaped line, made at run time from the turn
_PLANTED = "concat(text, chr(10), 'token = \"', md5(text), substr(md5(concat('t', text)), 1, 8), '\"')"
_texts("planted", f"""SELECT concat('conv-', role) AS project_id, concat('conv/', conv_id, '/', turn) AS file,
    CASE WHEN conv_id % 5 = 0 THEN {_PLANTED} ELSE text END AS content FROM conversations""")


@check("rs7_planted_conversations", with_("planted_hits", select=f"SELECT project_id, file, line, rule_id, severity, description, {_masked()} AS detail FROM planted_hits"))
def _(inp):
    turns = inp.table("conversations").withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.expr(_PLANTED)).otherwise(F.col("text")))
    return corpus.corpus_secret_scan(corpus.conversations_as_texts(turns)).select(*_SHORT)


@check("rs7_corpus_conversations", with_("conv_hits", select=f"SELECT project_id, file, line, rule_id, severity, description, {_masked()} AS detail FROM conv_hits"))
def _(inp):
    return corpus.corpus_secret_scan(corpus.conversations_as_texts(inp.table("conversations"))).select(*_SHORT)


_SECRET_RULES = tuple(r for r in CODE_RULES if r.pack == "hardcoded_secret")


@check("pf4_mask_evidence", with_("fx_files", CODE_LINES, select=f"""SELECT project_id, file, line, rule_id, {_shown(_SECRET_RULES)} AS detail
    FROM ({code_hits_sql(_SECRET_RULES)}) AS h JOIN {rules_table(_SECRET_RULES)} ON rl.n = h.n"""))
def _(inp):
    hits = code_scan.scan_code_lines(inp.files, _SECRET_RULES)
    return code_scan.mask_code_lines(hits, _SECRET_RULES).select("project_id", "file", "line", "rule_id", "detail")


# ------------------------------------------------------------------ findings of several scans

_COLUMNS = ("project_id", "rule_id", "severity", "description", "detail", "file", "line", "header", "table_name", "env_var", "env_source", "source")
_VAULT_FILE = VAULT_SQL.replace("AS detail", "AS detail, CASE path WHEN '.env.keys' THEN path END AS file")
_EXPOSED_RULE = "CASE WHEN starts_with(description, 'Supabase') THEN 'datastore.anon_key' ELSE 'datastore.firebase_key' END"
_OPEN_RULE = "CASE WHEN auth_combo = 'no-auth' THEN 'probe.no_auth' WHEN key_role = 'service_role' THEN 'probe.service_role' ELSE 'probe.anon' END"
#: every scan: its SQL, the columns it has, and its rule as SQL where it has none
_PARTS = {
    "env": (ENV_FINDINGS_SQL, {"rule_id", "file", "line"}, ""), "vault": (_VAULT_FILE, {"rule_id", "file"}, ""), "template": (TEMPLATE_SQL, {"rule_id"}, ""),
    "ignore": (IGNORE_SQL, {"rule_id"}, ""), "tracked": (TRACKED_SQL, {"file"}, "'repo.tracked_env'"),
    "code": (code_findings_sql(CODE_RULES), {"rule_id", "file", "line"}, ""),
    "leak": (LEAKS_SQL, {"rule_id", "file", "line", "env_var", "env_source"}, ""), "commit": (COMMIT_SQL, {"rule_id"}, ""),
    "http": (_ALL_HTTP, {"rule_id", "header", "source"}, ""), "hints": (HINTS_SQL, set(), "'datastore.hint'"), "keys": (EXPOSED_SQL, set(), _EXPOSED_RULE),
    "probe": (open_sql("ASC"), {"table_name"}, _OPEN_RULE), "traffic": (DEDUP_SQL, {"rule_id", "source", "env_var", "env_source"}, ""),
}


_SCANNERS = {"vault": "env", "template": "env", "ignore": "repo", "tracked": "repo", "commit": "history", "hints": "datastore", "keys": "datastore"}


def _part(scan: str, sql: str, have: set[str], rule: str) -> str:
    always = {"project_id", "severity", "description", "detail"}
    cols = ", ".join(c if c in have | always else f"{rule} AS rule_id" if c == "rule_id"
                     else f"CAST(NULL AS {'INTEGER' if c == 'line' else 'VARCHAR'}) AS {c}" for c in _COLUMNS)
    return f"SELECT {cols}, '{_SCANNERS.get(scan, scan)}' AS scanner FROM ({sql})"


FINDINGS = ["scan_lines", *IGNORE_BLOCKS, "last_values", LITERAL_LINES, TRACKED, "heads", "projects", CODE_LINES, DEPS, STACKS, *COMMIT_BLOCKS, "stores", "open_cells",
            "exposures", ("findings", " UNION ALL ".join(_part(scan, *part) for scan, part in _PARTS.items()))]


def fleet_of(inp) -> Fleet:
    return Fleet(inp.files, inp.commits, inp.tracked, inp.responses, inp.traffic, inp.pages, inp.probes)


def findings_of(inp) -> DataFrame:
    """The findings of the whole fleet, by all scans, written once per session like a user's."""
    return inp.stored("findings", lambda: fleet_findings(fleet_of(inp)))


@check("fleet_findings", with_(*FINDINGS, select=f"SELECT {', '.join(_COLUMNS)} FROM findings"))
def _(inp):
    return fleet_findings(fleet_of(inp)).select(*_COLUMNS)


@check("so1_union_findings", with_(*FINDINGS, select=f"SELECT {', '.join(_COLUMNS)} FROM findings"))
def _(inp):
    return findings_of(inp).select(*_COLUMNS)


_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "warning", "info"))
_SCORES = f"""SELECT p.project_id, coalesce(c.critical, 0) AS critical, coalesce(c.warning, 0) AS warning, coalesce(c.info, 0) AS info,
    greatest(0, 100 - 10 * coalesce(c.critical, 0) - 2 * coalesce(c.warning, 0)) AS score
    FROM (SELECT DISTINCT project_id FROM fx_files) AS p LEFT JOIN (SELECT project_id, {_COUNTS} FROM findings GROUP BY project_id) AS c ON c.project_id = p.project_id"""
_VERDICT = "CASE " + " ".join(f"WHEN score >= {floor} THEN {lit(text)}" for floor, text in VERDICTS) + " END"


@check("ag1_severity_counts", with_(*FINDINGS, select=f"SELECT project_id, {_COUNTS} FROM findings GROUP BY project_id"))
def _(inp):
    return scoring.severity_counts(findings_of(inp))


@check("ag1_severity_counts_by_scanner", with_(*FINDINGS, select=f"SELECT scanner, {_COUNTS} FROM findings GROUP BY scanner"))
def _(inp):
    return scoring.severity_counts(findings_of(inp), ("scanner",))


@check("ag2_risk_score", with_(*FINDINGS, select=_SCORES))
def _(inp):
    return scoring.risk_score(projects_of(inp.files), findings_of(inp))


@check("ag3_verdict", with_(*FINDINGS, select=f"SELECT project_id, score, {_VERDICT} AS verdict FROM ({_SCORES})"))
def _(inp):
    return scoring.verdict(scoring.risk_score(projects_of(inp.files), findings_of(inp))).select("project_id", "score", "verdict")


@check("ag4_gate", with_(*FINDINGS, select="SELECT project_id, bool_or(severity = 'critical') AS failed FROM findings GROUP BY project_id"))
def _(inp):
    return scoring.gate(findings_of(inp))


@check("fl3_worst_projects", with_(*FINDINGS, select=f"SELECT project_id, score FROM ({_SCORES}) ORDER BY score, project_id LIMIT 10"))
def _(inp):
    return scoring.worst_projects(scoring.risk_score(projects_of(inp.files), findings_of(inp))).select("project_id", "score")


@check("tk2_severity_listing", with_(*FINDINGS, select="""SELECT CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS rank,
    project_id, file, line, description FROM findings ORDER BY ALL"""))
def _(inp):
    listing = scoring.severity_listing(findings_of(inp))
    return listing.select(scoring.severity_rank(F.col("severity")).alias("rank"), "project_id", "file", "line", "description")


# ------------------------------------------------------------------ what a reader sees

_FILE = "concat(nullif(file, ''), CASE WHEN line > 0 THEN concat(':', line) ELSE '' END)"
_FILE = f"CASE WHEN file <> '' THEN {_FILE} END"
_TABLE = "CASE WHEN table_name <> '' THEN concat('tabel: ', table_name) END"
_LOCATION = (f"concat_ws(' · ', {_FILE}, {_TABLE}, CASE WHEN header <> '' THEN concat('header: ', header) END, env_var, "
             f"CASE WHEN env_source IS NOT NULL AND NOT coalesce(list_contains([{_FILE}, {_TABLE}, concat('header: ', header), env_var], env_source), false) THEN env_source END, source)")


@check("pf9_finding_location", with_(*FINDINGS, select=f"SELECT project_id, rule_id, description, {_LOCATION} AS location FROM findings"))
def _(inp):
    return report.finding_location(findings_of(inp)).select("project_id", "rule_id", "description", "location")


_NO = "CASE " + " ".join(f"WHEN contains(lower(description), {lit(k.lower())}) THEN {i}" for i, (k, _, _) in enumerate(GUIDANCE, 1)) + " END"
_GUIDE = values_sql([(i, e, r) for i, (_, e, r) in enumerate(GUIDANCE, 1)], "g", "no", "explanation", "remedy")
GUIDED = ("guided", f"""SELECT f.*, coalesce(g.explanation, '') AS explanation, coalesce(g.remedy, '') AS remedy
    FROM (SELECT *, {_NO} AS no FROM findings) AS f LEFT JOIN {_GUIDE} ON g.no = f.no""")


@check("jn17_remediation_lookup", with_(*FINDINGS, GUIDED, select="SELECT project_id, rule_id, description, explanation, remedy FROM guided"))
def _(inp):
    return report.remediation_lookup(findings_of(inp)).select("project_id", "rule_id", "description", "explanation", "remedy")


_IN_ENV = "coalesce(regexp_matches(string_split(replace(file, chr(92), '/'), '/')[-1], '^\\.env(\\..+)?$'), false)"
_WORDS = " OR ".join(f"contains(lower(description), {lit(w)})" for w in ENV_FILE_WORDS)


@check("pf10_env_display_override", with_(*FINDINGS, GUIDED, select=f"""SELECT project_id, rule_id, file, line,
    CASE WHEN {_IN_ENV} AND ({_WORDS}) THEN {lit(ENV_FILE_TITLE)} ELSE description END AS title,
    CASE WHEN {_IN_ENV} THEN {lit(ENV_FILE_EXPLANATION)} ELSE explanation END AS explanation,
    CASE WHEN {_IN_ENV} THEN {lit(ENV_FILE_REMEDY)} ELSE remedy END AS remedy FROM guided"""))
def _(inp):
    return report.env_display_override(findings_of(inp)).select("project_id", "rule_id", "file", "line", "title", "explanation", "remedy")


_NL = "chr(10)"
_PLACE = f"coalesce({_FILE}, {_TABLE}, CASE WHEN header <> '' THEN concat('header: ', header) END, '')"
_ENTRY = (f"concat('### ', description, {_NL}, CASE WHEN {_PLACE} <> '' THEN concat('- Placering: ', {_PLACE}, {_NL}) ELSE '' END, "
          f"CASE WHEN detail <> '' THEN concat('- Detalje: ', substr(detail, 1, 200), CASE WHEN length(detail) > 200 THEN '...' ELSE '' END, {_NL}) ELSE '' END, "
          f"CASE WHEN explanation <> '' THEN concat('- Problem: ', explanation, {_NL}) ELSE '' END, "
          f"CASE WHEN remedy <> '' THEN concat('- Fix:', {_NL}, remedy, {_NL}) ELSE '' END)")
_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END"
_TITLE = "CASE severity " + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in SECTION_TITLES.items()) + " END"
_HEADED = "concat('# Sikkerhedsanalyse - ', s.project_id, {0}, 'Score: ', s.score, '/100 - ', verdict, {0}, 'Stack: ', stack, {0})".format(_NL)
_LAST = "concat({0})".format(f", {_NL}, ".join((
    "'---'", "'Opgave: Gennemgå problemerne og hjælp med:'", "'1. Forklaring af hvert problem med konkrete kodeeksempler'", "'2. Konkrete rettelser med kode'",
    "'3. Prioriteret rækkefølge'", "concat('4. Yderligere anbefalinger til stakken (', stack, ')')")))
BRIEF = [*FINDINGS, GUIDED, ("scored", f"""SELECT s.*, {_VERDICT} AS verdict, coalesce(k.stack, 'Ikke detekteret') AS stack FROM ({_SCORES}) AS s
    LEFT JOIN (SELECT project_id, string_agg(stack, ', ' ORDER BY stack) AS stack FROM stacks GROUP BY project_id) AS k ON k.project_id = s.project_id"""),
    ("brief", f"""SELECT row_number() OVER (ORDER BY project_id, section, entry, file, line, description, text) - 1 AS position, project_id, text FROM (
        SELECT project_id, 0 AS section, 0 AS entry, '' AS file, 0 AS line, '' AS description, {_HEADED} AS text FROM scored AS s
        UNION ALL SELECT project_id, {_RANK}, 0, '', 0, '', concat('## ', {_TITLE}, ' (', count(*), '):') FROM guided GROUP BY project_id, severity
        UNION ALL SELECT project_id, {_RANK}, 1, coalesce(file, ''), coalesce(line, 0), description, {_ENTRY} FROM guided
        UNION ALL SELECT project_id, 9, 0, '', 0, '', {_LAST} FROM scored AS s)""")]


def brief_of(inp) -> DataFrame:
    findings = findings_of(inp)
    return report.remediation_brief(findings, scoring.scorecard(projects_of(inp.files), findings), stacks.project_stacks(inp.files))


@check("ag12_remediation_brief", with_(*BRIEF, select="SELECT * FROM brief"))
def _(inp):
    return brief_of(inp)


@check("ag12_brief_as_text", with_(*BRIEF, select=f"SELECT project_id, md5(string_agg(text, {_NL} ORDER BY position)) AS text_md5 FROM brief GROUP BY project_id"))
def _(inp):
    rows = brief_of(inp).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("r"))
    return rows.select("project_id", F.md5(F.array_join("r.text", "\n")).alias("text_md5"))


# ------------------------------------------------------------------ sinks


@check("snk1_findings_sink", with_(*FINDINGS, select="SELECT severity, project_id, rule_id, description, file, line FROM findings"))
def _(inp):
    folder, projects = f"{scratch(inp.spark)}/findings", projects_of(inp.files)
    # an older run had every finding twice over, and as critical; nothing of it may be left
    old = findings_of(inp).withColumn("severity", F.lit("critical"))
    write_findings(old.unionByName(old), projects, folder)
    write_findings(findings_of(inp), projects, folder)
    return read_findings(inp.spark, folder).select("severity", "project_id", "rule_id", "description", "file", "line")


@check("snk2_report_tables", with_(*BRIEF, *PROFILE_BLOCKS, select=f"""SELECT 'scorecard' AS report, project_id, concat_ws('/', score, critical, warning, info, verdict) AS value FROM scored
    UNION ALL SELECT 'profile', project_id, concat_ws('/', type, method, url, schema_file) FROM ({PROFILE_SQL})
    UNION ALL SELECT 'brief', project_id, concat_ws('/', position, md5(text)) FROM brief"""))
def _(inp):
    folder = f"{scratch(inp.spark)}/report"
    write_report(fleet_report(fleet_of(inp), findings_of(inp)), folder)
    read = lambda n, *values: inp.spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("report"), "project_id", F.concat_ws("/", *values).alias("value"))
    return (read("scorecard", "score", "critical", "warning", "info", "verdict").unionByName(read("profile", "type", "method", "url", "schema_file"))
            .unionByName(read("brief", F.col("position").cast("string"), F.md5("text"))))


# ------------------------------------------------------------------ the flagship

_DOC_SCORES = f"""SELECT p.project_id, coalesce(c.critical, 0) AS critical, coalesce(c.warning, 0) AS warning, coalesce(c.info, 0) AS info,
    greatest(0, 100 - 10 * coalesce(c.critical, 0) - 2 * coalesce(c.warning, 0)) AS score
    FROM (SELECT DISTINCT source AS project_id FROM documents) AS p LEFT JOIN (SELECT project_id, {_COUNTS} FROM doc_hits GROUP BY project_id) AS c ON c.project_id = p.project_id"""


@check("fleet_corpus_scorecard", with_("doc_hits", select=f"SELECT *, {_VERDICT} AS verdict, critical > 0 AS failed FROM ({_DOC_SCORES})"))
def _(inp):
    texts = corpus.documents_as_texts(inp.table("documents"))
    return scoring.scorecard(texts.select("project_id"), corpus.corpus_secret_scan(texts))
