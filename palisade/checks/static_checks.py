"""Cross-checks of files, environment, manifests, code rules, leaks and history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from palisade.checks.fixtures import values_sql
from palisade.checks.registry import check
from palisade.checks.sql import (
    every_rule, first_rule, lines_of, lit, match, placeholder, profile, rules_table, split_lines, strip, with_,
)
from palisade.functions.text import LINE_BREAK
from palisade.operators import code_scan, env_scan, leaks, repo, stacks
from palisade.operators.scoring import leak_spread
from palisade.rules.code import CODE_PACKS, CODE_RULES
from palisade.rules.model import Unless, rule
from palisade.rules.profiles import PROFILES
from palisade.rules.secrets import COMMIT_GLOBS, COMMIT_RULES, CRITICAL_IGNORES, ENV_FORMATS, ENV_KEY_NAMES, REQUIRED_IGNORES
from palisade.rules.stacks import JS_STACKS, PHP_STACKS, PORT_PATTERN, PORT_SCRIPTS, PROJECT_FILES, PYTHON_STACKS
from palisade.sources import commits as commit_source
from palisade.sources.files import select_files
from palisade.sources.manifests import manifest_dependencies, manifest_profile

# ------------------------------------------------------------------ files and lines


@check("src1_select_files", with_("fx_files", select=" UNION ALL ".join(
    f"SELECT '{n}' AS profile, project_id, path FROM fx_files WHERE {profile(n)}" for n in PROFILES)))
def _(inp):
    files = inp.files
    return reduce(lambda a, b: a.unionByName(b), [
        select_files(files, n).select(F.lit(n).alias("profile"), "project_id", "path") for n in PROFILES])


@check("pf1_explode_lines", with_("fx_files", select=f"""
    SELECT project_id, path, line, md5(text) AS text_md5 FROM ({lines_of('fx_files')})"""))
def _(inp):
    return env_scan.explode_lines(inp.files).select("project_id", "path", "line", F.md5("text").alias("text_md5"))


# ------------------------------------------------------------------ environment files


@check("pf2_parse_env_pairs", with_("env_pairs", select="SELECT project_id, path, line, key, value FROM env_pairs"))
def _(inp):
    lines = env_scan.explode_lines(select_files(inp.files, "env_values").select("project_id", "path", "content"))
    return env_scan.parse_env_pairs(lines).select("project_id", "path", "line", "key", "value")


@check("pf3_drop_placeholders", with_("env_pairs", select=f"""
    SELECT 'extraction' AS use, project_id, path, line, key FROM env_pairs WHERE NOT {placeholder('value', 4, False)}
    UNION ALL SELECT 'rules', project_id, path, line, key FROM env_pairs WHERE NOT {placeholder('value', 3, True)}"""))
def _(inp):
    lines = env_scan.explode_lines(select_files(inp.files, "env_values").select("project_id", "path", "content"))
    pairs = env_scan.parse_env_pairs(lines).select("project_id", "path", "line", "key", "value")
    out = lambda use, df: df.select(F.lit(use).alias("use"), "project_id", "path", "line", "key")
    return out("extraction", env_scan.drop_placeholders(pairs)).unionByName(
        out("rules", env_scan.drop_placeholders(pairs, 3, True)))


_MASK = f"concat(CASE WHEN contains(text, '=') THEN {strip('string_split(text, chr(61))[1]')} ELSE substr(text, 1, 30) END, '=***')"


def _env_hits(rules) -> str:
    return f"""SELECT project_id, file, line, rule_id, severity, description, detail FROM (
        SELECT *, {first_rule(rules, 'text')} AS n, {_MASK} AS detail FROM scan_lines) AS h
        JOIN {rules_table(rules)} ON rl.n = h.n"""


@check("rs2_scan_env_format", with_("scan_lines", select=_env_hits(ENV_FORMATS)))
def _(inp):
    return env_scan.scan_env_format(inp.files)


@check("rs3_scan_env_keynames", with_("scan_lines", select=_env_hits(ENV_KEY_NAMES)))
def _(inp):
    return env_scan.scan_env_keynames(inp.files)


@check("wd2_env_hit_dedup", with_("scan_lines", select=f"""SELECT DISTINCT project_id, file, line, description
    FROM ({_env_hits(ENV_FORMATS)} UNION ALL {_env_hits(ENV_KEY_NAMES)})"""))
def _(inp):
    # the same hits twice, as when two globs list a file
    files = inp.files
    twice = reduce(lambda a, b: a.unionByName(b), [
        env_scan.scan_env_format(files), env_scan.scan_env_keynames(files), env_scan.scan_env_format(files)])
    return env_scan.env_hit_dedup(twice).select("project_id", "file", "line", "description")


@check("wd3_first_rule_wins", with_("scan_lines", select=f"""SELECT project_id, file, line,
    {first_rule(ENV_FORMATS, 'text')} AS format_rule, {first_rule(ENV_KEY_NAMES, 'text')} AS name_rule FROM scan_lines
    WHERE {first_rule(ENV_FORMATS, 'text')} IS NOT NULL AND {first_rule(ENV_KEY_NAMES, 'text')} IS NOT NULL"""))
def _(inp):
    number = lambda rules, c: F.array_position(F.array(*[F.lit(r.rule_id) for r in rules]), F.col(c)).cast("int")
    formats = env_scan.scan_env_format(inp.files).select("project_id", "file", "line", F.col("rule_id").alias("f"))
    names = env_scan.scan_env_keynames(inp.files).select("project_id", "file", "line", F.col("rule_id").alias("k"))
    return formats.join(names, ["project_id", "file", "line"]).select(
        "project_id", "file", "line", number(ENV_FORMATS, "f").alias("format_rule"), number(ENV_KEY_NAMES, "k").alias("name_rule"))


_NAME = f"upper({strip('string_split(detail, chr(61))[1]')})"
_TEXT = "replace(replace(description, 'hardcodet', 'fundet i .env'), ' – ALDRIG i frontend', '')"
_PUBLIC = f"starts_with({_NAME}, 'NEXT_PUBLIC_')"
_ADMIN = f"(contains(lower({_NAME}), 'service_role') OR contains(lower({_TEXT}), 'service_role'))"
ENV_FINDINGS_SQL = f"""SELECT project_id, file, line, rule_id,
    CASE WHEN {_PUBLIC} AND {_ADMIN} THEN 'critical' WHEN {_PUBLIC} THEN 'warning' ELSE 'info' END AS severity,
    CASE WHEN {_PUBLIC} AND {_ADMIN} THEN 'service_role nøgle med NEXT_PUBLIC_ prefix i .env – eksponeres i klientbundlet og giver admin-adgang til databasen'
         WHEN {_PUBLIC} THEN concat({_TEXT}, ' – ADVARSEL: NEXT_PUBLIC_ variabler eksponeres i klientbundlet')
         WHEN contains({_TEXT}, 'gitignored') THEN {_TEXT}
         ELSE concat({_TEXT}, ' – sørg for at .env er gitignored') END AS description, detail, true AS env_file
    FROM ({_env_hits(ENV_FORMATS)} UNION ALL {_env_hits(ENV_KEY_NAMES)})"""
_SHORT = ("project_id", "file", "line", "rule_id", "severity", "description", "detail")


@check("pf7_env_context_severity", with_("scan_lines", select=ENV_FINDINGS_SQL))
def _(inp):
    return env_scan.env_findings(inp.files).select(*_SHORT, "env_file")


@check("wd8_last_env_value", with_("last_values", select="SELECT project_id, key, value, source FROM last_values"))
def _(inp):
    return env_scan.last_env_value(env_scan.env_values(inp.files)).select("project_id", "key", "value", "source")


TEMPLATE_SQL = """SELECT project_id, 'env.missing_template' AS rule_id, 'info' AS severity,
    '.env.example mangler – god praksis at have en' AS description,
    'Opret .env.example med placeholders for alle nødvendige variabler' AS detail
    FROM projects WHERE project_id NOT IN
      (SELECT project_id FROM fx_files WHERE path IN ('.env.example', '.env.sample', '.env.template'))"""


@check("jn13_missing_env_template", with_("projects", select=TEMPLATE_SQL))
def _(inp):
    return env_scan.missing_env_template(inp.files).select("project_id", "rule_id", "severity", "description", "detail")


VAULT_SQL = """SELECT project_id, CASE path WHEN '.env.keys' THEN 'env.vault_keys' ELSE 'env.vault' END AS rule_id,
    CASE path WHEN '.env.keys' THEN 'critical' ELSE 'info' END AS severity,
    CASE path WHEN '.env.keys' THEN '.env.keys fil fundet – indeholder master-krypteringsnøgler'
      ELSE '.env.vault fundet – projekt bruger Dotenv Vault kryptering' END AS description,
    CASE path WHEN '.env.keys' THEN 'Tilføj .env.keys til .gitignore OMGÅENDE'
      ELSE 'Husk at .env.keys ALDRIG må commites til git' END AS detail
    FROM fx_files WHERE path IN ('.env.vault', '.env.keys')"""


@check("jn14_vault_files", with_("fx_files", select=VAULT_SQL))
def _(inp):
    return env_scan.vault_files(inp.files).select("project_id", "rule_id", "severity", "description", "detail")


# ------------------------------------------------------------------ manifests and stacks

_JSON = "(SELECT *, CASE WHEN json_valid(content) THEN content END AS j FROM fx_files)"
DEPS_SQL = " UNION ".join(
    f"SELECT project_id, '{eco}' AS ecosystem, lower(unnest(json_keys(j, '$.\"{section}\"'))) AS dep FROM {_JSON} WHERE path = '{name}' AND j IS NOT NULL"
    for eco, name, section in (("js", "package.json", "dependencies"), ("js", "package.json", "devDependencies"),
                               ("php", "composer.json", "require"), ("php", "composer.json", "require-dev")))
_SIGS = values_sql([(e, d, s) for e, t in (("js", JS_STACKS), ("php", PHP_STACKS)) for s, ds in t.items() for d in ds],
                   "s", "ecosystem", "dep", "stack")
_DEP_STACKS = f"SELECT DISTINCT project_id, stack FROM deps AS d JOIN {_SIGS} ON d.ecosystem = s.ecosystem AND d.dep = s.dep"
_TEXT_STACKS = f"""SELECT DISTINCT project_id, stack FROM fx_files AS f
    JOIN {values_sql(list(PYTHON_STACKS.items()), 's', 'stack', 'sig')} ON contains(lower(content), sig)
    WHERE path IN ('requirements.txt', 'pyproject.toml')"""
DEPS = ("deps", DEPS_SQL)
STACKS = ("stacks", f"{_DEP_STACKS} UNION {_TEXT_STACKS}")


@check("src2_manifest_dependencies", with_("fx_files", select=DEPS_SQL))
def _(inp):
    return manifest_dependencies(inp.files)


_PORT = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(json_extract_string(j, '$.scripts.{s}'), {lit(PORT_PATTERN)}, 1), '')" for s in PORT_SCRIPTS) + ")"


@check("src3_manifest_profile", with_("fx_files", select=f"""SELECT project_id,
    bool_or(path IN ({', '.join(lit(p) for p in PROJECT_FILES)})) AS has_project_file,
    coalesce(max(CASE WHEN path = 'package.json' THEN CAST({_PORT} AS INTEGER) END), -1) AS port_hint FROM {_JSON} GROUP BY project_id"""))
def _(inp):
    return manifest_profile(inp.files).fillna({"port_hint": -1})


@check("jn3_stack_from_deps", with_("fx_files", DEPS, select=_DEP_STACKS))
def _(inp):
    return stacks.stack_from_deps(manifest_dependencies(inp.files))


@check("jn4_stack_from_text", with_("fx_files", select=_TEXT_STACKS))
def _(inp):
    return stacks.stack_from_text(inp.files)


@check("so3_stack_union", with_("fx_files", DEPS, select=STACKS[1]))
def _(inp):
    return stacks.project_stacks(inp.files)


# ------------------------------------------------------------------ code rules


def _shown(rules) -> str:
    masked = strip("text")
    own = [r for r in rules if r.pack == code_scan.SECRET_PACK and r not in CODE_RULES]
    for r in [r for r in CODE_RULES if r.pack == code_scan.SECRET_PACK] + own:
        masked = f"regexp_replace({masked}, {lit(r.regex)}, '***', 'g')"
    return f"substr({masked}, 1, 120)"


def _first_part(r) -> str:
    """Text before a whole-file match; the head marks where a guarded match starts."""
    head = r.pattern.head if isinstance(r.pattern, Unless) else r.pattern
    return f"regexp_split_to_array(content, {lit(head)})[1]"


def code_hits_sql(rules) -> str:
    """Every hit: project, file, rule number, line, text."""
    by_line = [r for r in rules if r.scope == "line"]
    numbers = {r.rule_id: i for i, r in enumerate(rules, 1)}
    parts = []
    if by_line:
        tests = ", ".join(f"CASE WHEN {match(r.pattern, 'text')} THEN {numbers[r.rule_id]} END" for r in by_line)
        parts.append(f"""SELECT project_id, path AS file, line, text, unnest(list_filter([{tests}], lambda n: n IS NOT NULL)) AS n
            FROM code_lines""")
    for r in rules:
        if r.scope == "file":
            names = "".join(f" OR name = {lit(n)}" for n in r.extra_names)
            parts.append(f"""SELECT project_id, path AS file, len(regexp_split_to_array({_first_part(r)}, {lit(LINE_BREAK)})) AS line,
                {split_lines('content')}[len(regexp_split_to_array({_first_part(r)}, {lit(LINE_BREAK)}))] AS text, {numbers[r.rule_id]} AS n
                FROM fx_files WHERE (({profile('code')}){names}) AND {match(r.pattern, 'content')}""")
    return " UNION ALL ".join(parts)


CODE_LINES = ("code_lines", lines_of("fx_files", where=profile("code")))


def code_findings_sql(rules, gated: bool = True) -> str:
    gate = ("WHERE rl.stack = '' OR EXISTS (SELECT 1 FROM stacks AS s WHERE s.project_id = f.project_id AND s.stack = rl.stack)"
            if gated else "")
    return f"""SELECT project_id, file, line, rule_id, severity, description, {_shown(rules)} AS detail FROM (
        SELECT f.project_id, file, f.line, f.text, rl.rule_id, rl.severity, rl.description FROM (
          SELECT project_id, file, n, min(line) AS line, arg_min(text, line) AS text FROM ({code_hits_sql(rules)}) GROUP BY project_id, file, n) AS f
        JOIN {rules_table(rules)} ON rl.n = f.n {gate})"""


def _pack_check(pack: str):
    rules = tuple(r for r in CODE_RULES if r.pack == pack)
    blocks = ["fx_files", CODE_LINES] + ([DEPS, STACKS] if any(r.stack for r in rules) else [])

    @check(f"rs1_{pack}", with_(*blocks, select=code_findings_sql(rules, any(r.stack for r in rules))))
    def _(inp):
        files = inp.files
        return code_scan.code_findings(files, stacks.project_stacks(files), rules).select(*_SHORT)


for _pack in CODE_PACKS:
    _pack_check(_pack)


@check("rs1_scan_code_lines", with_("fx_files", CODE_LINES, DEPS, STACKS, select=code_findings_sql(CODE_RULES)))
def _(inp):
    files = inp.files
    return code_scan.code_findings(files, stacks.project_stacks(files)).select(*_SHORT)


_WD1 = CODE_RULES


@check("wd1_first_hit_per_file", with_("fx_files", CODE_LINES, select=f"""
    SELECT project_id, file, rule_id, min(line) AS line FROM ({code_hits_sql(_WD1)}) AS h JOIN {rules_table(_WD1)} ON rl.n = h.n
    GROUP BY project_id, file, rule_id"""))
def _(inp):
    hits = code_scan.scan_code_lines(inp.files, _WD1)
    return code_scan.first_hit_per_file(hits).select("project_id", "file", "rule_id", "line")


_GATED = tuple(r for r in CODE_RULES if r.stack)


@check("jn5_stack_gate", with_("fx_files", CODE_LINES, DEPS, STACKS, select=f"""
    SELECT h.project_id, file, line, rule_id, stack FROM ({code_hits_sql(_GATED)}) AS h JOIN {rules_table(_GATED)} ON rl.n = h.n
    WHERE EXISTS (SELECT 1 FROM stacks AS s WHERE s.project_id = h.project_id AND s.stack = rl.stack)"""))
def _(inp):
    files = inp.files
    hits = code_scan.scan_code_lines(files, _GATED)
    return code_scan.stack_gate(hits, stacks.project_stacks(files)).select("project_id", "file", "line", "rule_id", "stack")


_CUSTOM = (
    rule("custom.todo_marker", "info", r"\bTODO\b|\bFIXME\b", "Marker left in code"),
    rule("custom.await_in_line", "warning", r"await\s+\w+\(", "Awaited call", "await"),
    rule("custom.react_only", "critical", r"const\s+\w+\s*=", "Constant in a React project", "const", stack="React"),
)


@check("ex1_custom_rules", with_("fx_files", CODE_LINES, DEPS, STACKS, select=code_findings_sql(_CUSTOM)))
def _(inp):
    files = inp.files
    return code_scan.code_findings(files, stacks.project_stacks(files), _CUSTOM).select(*_SHORT)


# ------------------------------------------------------------------ leaks and history

LITERAL_LINES = ("literal_lines", lines_of("fx_files", where=profile("literal")))
LEAKS_SQL = """SELECT l.project_id, l.path AS file, min(l.line) AS line, 'leak.hardcoded_env' AS rule_id, 'critical' AS severity,
    concat('Hardcodet secret (', v.key, ') fundet i kildekode') AS description,
    concat('Værdien fra ', v.source, ' er hardcodet i stedet for at bruge env-variablen. Fjern værdien og brug process.env.',
           v.key, ' / import.meta.env.', v.key) AS detail, v.key AS env_var, v.source AS env_source
    FROM literal_lines AS l JOIN last_values AS v ON l.project_id = v.project_id AND length(v.value) >= 20 AND contains(l.text, v.value)
    GROUP BY l.project_id, l.path, v.key, v.source"""


@check("jn1_hardcoded_env_values", with_("last_values", LITERAL_LINES, select=LEAKS_SQL))
def _(inp):
    return leaks.hardcoded_env_values(inp.files).select(*_SHORT, "env_var", "env_source")


@check("jn1_hardcoded_env_values_salted", with_("last_values", LITERAL_LINES, select=LEAKS_SQL))
def _(inp):
    return leaks.hardcoded_env_values(inp.files, broadcast=False).select(*_SHORT, "env_var", "env_source")


_SPREAD = CODE_RULES


@check("fl1_leak_spread", with_("last_values", LITERAL_LINES, CODE_LINES, DEPS, STACKS, select=f"""
    SELECT project_id, 'env_var' AS kind, env_var AS name, count(DISTINCT file) AS files FROM ({LEAKS_SQL}) GROUP BY project_id, env_var
    UNION ALL SELECT project_id, 'rule', rule_id, count(DISTINCT file) FROM ({code_findings_sql(_SPREAD)}) GROUP BY project_id, rule_id"""))
def _(inp):
    files = inp.files
    found = code_scan.code_findings(files, stacks.project_stacks(files), _SPREAD)
    return leak_spread(leaks.hardcoded_env_values(files).unionByName(found))


def _covered(r: str) -> str:
    q = lit(r)
    test = (f"contains(t, {q}) OR contains({q}, t) OR (ends_with(t, '*') AND starts_with({q}, substr(t, 1, length(t) - 1)))"
            f" OR (ends_with(t, '.*') AND starts_with({q}, substr(t, 1, length(t) - 2)))")
    if r.startswith(".env"):
        test += f" OR (starts_with(t, '.env') AND (t IN ('.env*', '.env', '.env.*') OR starts_with({q}, rtrim(t, '*.'))))"
    return test


_IGNORE_LINES = ("ignore_lines", f"SELECT project_id, t FROM (SELECT project_id, {strip('text')} AS t FROM ("
                 + lines_of("fx_files", where="path = '.gitignore'") + ")) WHERE t <> '' AND NOT starts_with(t, '#')")
IGNORE_SQL = " UNION ALL ".join(
    f"""SELECT project_id, 'repo.ignore_gap' AS rule_id, '{'critical' if r in CRITICAL_IGNORES else 'warning'}' AS severity,
        concat(chr(39), {lit(r)}, chr(39), ' er ikke dækket af .gitignore') AS description,
        concat('Tilføj ', chr(39), {lit(r)}, chr(39), ' til .gitignore for at beskytte sensitive filer') AS detail
        FROM fx_files AS f WHERE path = '.gitignore' AND NOT EXISTS
          (SELECT 1 FROM ignore_lines AS i WHERE i.project_id = f.project_id AND ({_covered(r)}))""" for r in REQUIRED_IGNORES) + """
    UNION ALL SELECT project_id, 'repo.no_ignore_file', 'critical', '.gitignore fil mangler helt',
        'Opret en .gitignore fil omgående – alle .env-filer er i fare' FROM projects
        WHERE project_id NOT IN (SELECT project_id FROM fx_files WHERE path = '.gitignore')"""
IGNORE_BLOCKS = ("projects", _IGNORE_LINES)


@check("jn11_ignore_coverage", with_(*IGNORE_BLOCKS, select=IGNORE_SQL))
def _(inp):
    return repo.ignore_coverage(inp.files).select("project_id", "rule_id", "severity", "description", "detail")


TRACKED = ("fx_tracked", "SELECT project_id, path FROM fx_files WHERE substr(md5(project_id), 1, 1) < '8'")
TRACKED_SQL = """SELECT project_id, path AS file, 'critical' AS severity, concat(chr(39), path, chr(39), ' er tracked af git') AS description,
    concat('Kør: git rm --cached ', path, ' && echo ', chr(39), path, chr(39), ' >> .gitignore') AS detail
    FROM fx_tracked WHERE contains(path, '.env')"""


@check("jn12_tracked_env_files", with_("fx_files", TRACKED, select=TRACKED_SQL))
def _(inp):
    return repo.tracked_env_files(inp.tracked).select("project_id", "file", "severity", "description", "detail")


_GLOBS = "|".join("^" + g.replace(".", "\\.").replace("*", ".*") + "$" for g in COMMIT_GLOBS)
_TOUCHED = ("touched", f"SELECT * FROM fx_commits WHERE regexp_matches(path, {lit(_GLOBS)})")
_HISTORY = ("history", "SELECT * FROM touched")
COMMIT_BLOCKS = ("fx_commits", _TOUCHED, _HISTORY)


def _at_second():
    return (F.unix_timestamp("committed_at") - 1704067200).alias("at_second")


def _timed(hits: DataFrame) -> DataFrame:
    return hits.withColumn("at_second", _at_second()).drop("committed_at")


@check("src4_commit_lines", with_(*COMMIT_BLOCKS, select="""
    SELECT project_id, commit_sha, at_second, path, line_no, change, md5(line) AS line_md5 FROM history"""))
def _(inp):
    return commit_source.commit_lines(inp.commits).select(
        "project_id", "commit_sha", _at_second(), "path", "line_no", "change", F.md5("line").alias("line_md5"))


@check("src4_newest_commits", with_(*COMMIT_BLOCKS, select="""
    SELECT h.project_id, h.commit_sha, path, line_no FROM history AS h JOIN (
      SELECT project_id, commit_sha, row_number() OVER (PARTITION BY project_id ORDER BY at_second DESC, commit_sha) AS r
      FROM (SELECT DISTINCT project_id, commit_sha, at_second FROM touched)) AS n
    ON n.project_id = h.project_id AND n.commit_sha = h.commit_sha WHERE n.r <= 50"""))
def _(inp):
    return commit_source.commit_lines(inp.commits, limit=50).select("project_id", "commit_sha", "path", "line_no")


@check("wd5_recent_commits", with_("fx_commits", select="""SELECT * FROM (SELECT project_id, commit_sha,
    row_number() OVER (PARTITION BY project_id ORDER BY at_second DESC, commit_sha) AS commit_rank
    FROM (SELECT DISTINCT project_id, commit_sha, at_second FROM fx_commits)) WHERE commit_rank <= 50"""))
def _(inp):
    return commit_source.recent_commits(inp.commits).select("project_id", "commit_sha", "commit_rank")


_COMMIT_HITS = f"""SELECT h.project_id, h.commit_sha, h.at_second, h.path, h.line_no, rl.rule_id, rl.severity, rl.description
    FROM (SELECT *, {every_rule(COMMIT_RULES, 'line')} AS n FROM history) AS h JOIN {rules_table(COMMIT_RULES)} ON rl.n = h.n"""
_FIRST_LEAK = f"""SELECT project_id, rule_id, severity, description, arg_min(commit_sha, (-at_second, commit_sha, path, line_no)) AS commit_sha
    FROM ({_COMMIT_HITS}) GROUP BY project_id, rule_id, severity, description"""


@check("rs4_scan_commit_patches", with_(*COMMIT_BLOCKS, select=_COMMIT_HITS))
def _(inp):
    return _timed(repo.scan_commit_patches(commit_source.commit_lines(inp.commits)))


@check("rs4_added_lines_only", with_(*COMMIT_BLOCKS, select=f"SELECT q.* FROM ({_COMMIT_HITS}) AS q JOIN "
       "(SELECT DISTINCT project_id, commit_sha, line_no, change FROM history) AS c "
       "ON c.project_id = q.project_id AND c.commit_sha = q.commit_sha AND c.line_no = q.line_no WHERE c.change = '+'"))
def _(inp):
    return _timed(repo.scan_commit_patches(commit_source.commit_lines(inp.commits), changes=("+",)))


@check("wd6_first_leak_commit", with_(*COMMIT_BLOCKS, select=_FIRST_LEAK))
def _(inp):
    return repo.first_leak_commit(repo.scan_commit_patches(commit_source.commit_lines(inp.commits)))


COMMIT_SQL = f"""SELECT project_id, rule_id, severity, concat('Secret fundet i git-historik: ', description) AS description,
    concat('Mønster matchede i commit ~', substr(commit_sha, 1, 8),
      '. Brug ''git filter-repo'' eller BFG Repo-Cleaner til at fjerne det.') AS detail FROM ({_FIRST_LEAK})"""


@check("rs4_commit_findings", with_(*COMMIT_BLOCKS, select=COMMIT_SQL))
def _(inp):
    return repo.commit_findings(commit_source.commit_lines(inp.commits)).select(
        "project_id", "rule_id", "severity", "description", "detail")
