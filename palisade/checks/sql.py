"""Pieces of DuckDB SQL for the cross-checks.

The regular expressions there know no look-around, so a guarded rule is tested by trying every place
where the text can be cut in two: the first half must end with the head, the second must not start with
a guard and must start with the tail.
"""

from __future__ import annotations

from collections.abc import Sequence

from palisade.checks.fixtures import FIXTURE_SQL, values_sql
from palisade.functions.text import LINE_BREAK
from palisade.rules.model import Rule, Unless
from palisade.rules.profiles import PROFILES
from palisade.rules.secrets import PLACEHOLDERS

SPACES = "concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12))"


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def unquote(x: str) -> str:
    return strip(f"trim(trim({strip(x)}, '\"'), chr(39))")


def match(pattern: str | Unless, x: str) -> str:
    if isinstance(pattern, str):
        return f"regexp_matches({x}, {lit(pattern)})"
    left, right = f"substr({x}, 1, p)", f"substr({x}, p + 1)"
    tests = [f"regexp_matches({left}, {lit('(?:' + pattern.head + ')$')})"]
    tests += [f"NOT regexp_matches({right}, {lit('^(?:' + g + ')')})" for g in pattern.guards]
    if pattern.tail:
        tests.append(f"regexp_matches({right}, {lit('^(?:' + pattern.tail + ')')})")
    return (f"(regexp_matches({x}, {lit(pattern.head)}) AND "
            f"len(list_filter(range(0, length({x}) + 1), lambda p: {' AND '.join(tests)})) > 0)")


def first_rule(rules: Sequence[Rule], x: str) -> str:
    return "CASE " + " ".join(f"WHEN {match(r.pattern, x)} THEN {i}" for i, r in enumerate(rules, 1)) + " END"


def every_rule(rules: Sequence[Rule], x: str) -> str:
    tests = ", ".join(f"CASE WHEN {match(r.pattern, x)} THEN {i} END" for i, r in enumerate(rules, 1))
    return f"unnest(list_filter([{tests}], lambda n: n IS NOT NULL))"


def rules_table(rules: Sequence[Rule], alias: str = "rl") -> str:
    rows = [(i, r.rule_id, r.severity, r.description, r.stack or "") for i, r in enumerate(rules, 1)]
    return values_sql(rows, alias, "n", "rule_id", "severity", "description", "stack")


def profile(name: str) -> str:
    p = PROFILES[name]
    tests = []
    if p.extensions:
        tests.append(f"ext IN {in_list(p.extensions)}")
    if p.names:
        tests.append(f"name IN {in_list(p.names)}")
    tests += [f"starts_with(name, {lit(x)})" for x in p.name_prefixes]
    out = "(" + " OR ".join(tests) + ")"
    out += "".join(f" AND NOT starts_with(name, {lit(x)})" for x in p.skip_prefixes)
    if p.excluded_dirs:
        out += f" AND NOT list_has_any(string_split(path, '/'), [{', '.join(lit(d) for d in p.excluded_dirs)}])"
    return out


def split_lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {lit(LINE_BREAK)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def lines_of(table: str, keep: str = "project_id, path, name", where: str = "true", content: str = "content") -> str:
    return (f"SELECT {keep}, generate_subscripts(parts, 1) AS line, unnest(parts) AS text FROM "
            f"(SELECT *, {split_lines(content)} AS parts FROM {table} WHERE {where})")


def placeholder(v: str, min_len: int, python_format: bool) -> str:
    v = unquote(v)
    test = f"length({v}) < {min_len} OR lower({v}) IN {in_list(PLACEHOLDERS)} OR (starts_with({v}, '${{') AND ends_with({v}, '}}'))"
    if python_format:
        test += f" OR (starts_with({v}, '%(') AND ends_with({v}, ')s'))"
    return f"({test})"


def with_(*names_or_pairs, select: str) -> str:
    """A WITH query: a name picks a shared block and what it needs, a pair adds one."""
    blocks: dict[str, str] = {}

    def add(item):
        if isinstance(item, tuple):
            blocks[item[0]] = item[1]
            return
        needs, sql = BLOCKS[item]
        for n in needs:
            if n not in blocks:
                add(n)
        blocks.setdefault(item, sql)

    for item in names_or_pairs:
        add(item)
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in blocks.items()) + " " + select


_FIRST_RANK = "CASE name WHEN '.env' THEN 0 WHEN 'env.local' THEN 2 ELSE 1 END"
_LAST_RANK = ("CASE name WHEN '.env' THEN 0 WHEN 'env.local' THEN 2 WHEN '.env.local' THEN 3 WHEN '.env.development' THEN 4 "
              "WHEN '.env.production' THEN 5 WHEN '.env.staging' THEN 6 WHEN '.env.test' THEN 7 WHEN '.env.preview' THEN 8 ELSE 1 END")

_T = strip("text")
_AFTER = "substr(t, instr(t, '=') + 1)"
_B64 = "translate(string_split(token, '.')[2], '-_', '+/')"

# shared blocks: name -> (blocks it reads, sql)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {name: ((), sql) for name, sql in FIXTURE_SQL.items()}
BLOCKS.update({
    "projects": (("fx_files",), "SELECT DISTINCT project_id FROM fx_files"),
    "env_pairs": (("fx_files",), f"""
        SELECT project_id, path, name, line, {strip("substr(t, 1, instr(t, '=') - 1)")} AS key, {unquote(_AFTER)} AS value
        FROM (SELECT *, {_T} AS t FROM ({lines_of('fx_files', where=profile('env_values'))}))
        WHERE t <> '' AND NOT starts_with(t, '#') AND contains(t, '=') AND {unquote(_AFTER)} <> ''"""),
    "env_vars": (("env_pairs",), f"""
        SELECT project_id, path AS source, line, key, value, {_FIRST_RANK} AS first_rank, {_LAST_RANK} AS last_rank
        FROM env_pairs WHERE NOT {placeholder('value', 4, False)}"""),
    "last_values": (("env_vars",), """
        SELECT project_id, key, arg_max(value, (last_rank, source, line)) AS value,
               arg_max(source, (last_rank, source, line)) AS source, min((first_rank, source, line)) AS first_seen
        FROM env_vars WHERE length(value) >= 8 GROUP BY project_id, key"""),
    "scan_lines": (("fx_files",), f"""
        SELECT project_id, path AS file, line, t AS text FROM (SELECT *, {_T} AS t FROM ({lines_of('fx_files', where=profile('env'))}))
        WHERE t <> '' AND NOT starts_with(t, '#') AND NOT (contains(t, '=') AND {placeholder(_AFTER, 3, True)})"""),
    "credentials": (("env_vars",), f"""
        SELECT project_id, key AS var, token, CASE WHEN claimed <> '' AND claimed <> 'unknown' THEN claimed
                 WHEN contains(upper(key), 'SERVICE') THEN 'service_role' WHEN contains(upper(key), 'ANON') THEN 'anon' ELSE 'unknown' END AS role,
               is_jwt, source, line, first_rank
        FROM (SELECT *, CASE WHEN is_jwt AND len(string_split(token, '.')) = 3 THEN json_extract_string(decode(from_base64(
                rpad({_B64}, CAST(ceil(length({_B64}) / 4) * 4 AS INTEGER), '='))), '$.role') END AS claimed
              FROM (SELECT *, value AS token, regexp_matches(value, 'eyJ[A-Za-z0-9_\\-]{{50,}}\\.[A-Za-z0-9_\\-]{{10,}}') AS is_jwt
                    FROM env_vars WHERE length(value) >= 20))"""),
    "unique_keys": (("credentials",), """
        SELECT project_id, token, c.var AS var, c.role AS role, c.is_jwt AS is_jwt, c.source AS source, c.line AS line, c.first_rank AS first_rank
        FROM (SELECT project_id, token, arg_min({'var': var, 'role': role, 'is_jwt': is_jwt, 'source': source, 'line': line, 'first_rank': first_rank},
              (first_rank, source, line)) AS c FROM credentials GROUP BY project_id, token)"""),
})
