"""Inputs of the checks, derived from the supplied tables.

The supplied tables hold no code, environment files, headers, commits or traffic, so these are built
from them: every document becomes a source file, some also an environment file of a package; groups of
documents become projects with root files; every page a response; every event a request.  Size therefore
follows the tables, and one project ("monorepo") holds a third of everything.

Each table is one SELECT in the part of SQL that Spark and DuckDB share, so both build the same rows.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.checks.snippets import CODE_EXAMPLES, ENV_LINES
from palisade.rules.code import CODE_RULES
from palisade.rules.datastores import AUTH_COMBOS, CRITICAL_TABLES
from palisade.session import prepare
from palisade.sources.captures import parse_header_block
from palisade.sources.shared import new_folder, write_splittable


def text_sql(text: str) -> str:
    """A string both engines read alike: quotes, backslashes, dollars and line breaks go through ``chr``."""
    special = {"'": 39, "\\": 92, "\n": 10, "\r": 13, "\t": 9, "$": 36}
    parts, run = [], ""
    for c in text:
        if c in special:
            if run:
                parts.append(f"'{run}'")
            parts.append(f"chr({special[c]})")
            run = ""
        else:
            run += c
    if run or not parts:
        parts.append(f"'{run}'")
    return parts[0] if len(parts) == 1 else "concat(" + ", ".join(parts) + ")"


def values_sql(rows, alias: str, *columns: str) -> str:
    cell = lambda v: text_sql(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {alias}_v({', '.join(columns)})) AS {alias}"


def _jwt(role: str) -> str:
    """Header and payload of a token; the signature is filled in per row."""
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d, separators=(",", ":")).encode()).decode().rstrip("=")
    return (part({"alg": "HS256", "typ": "JWT"}) + "."
            + part({"iss": "database", "ref": "abcdefghijklmnop", "role": role, "iat": 1700000000}) + ".")


def fill_sql(template: str, seed: str) -> str:
    """Replace the placeholders of a template column by values derived from a seed expression."""
    h32, h16 = f"md5({seed})", f"substr(md5({seed}), 1, 16)"
    fills = {
        "<jwt_service>": f"concat({text_sql(_jwt('service_role'))}, md5({seed}))",
        "<jwt_anon>": f"concat({text_sql(_jwt('anon'))}, md5({seed}))",
        "<h32>": h32, "<h16>": h16, "<h8>": f"substr(md5({seed}), 1, 8)",
        "<h40>": f"concat({h32}, substr(md5({seed}), 1, 8))", "<H16>": f"upper({h16})",
    }
    for mark, value in fills.items():
        template = f"replace({template}, '{mark}', {value})"
    return template


_EXTS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte", ".py", ".php", ".rb", ".go", ".java",
         ".cs", ".rs", ".kt", ".scala", ".json", ".md", ".html")
_SNIPPETS = [s for pair in CODE_EXAMPLES.values() for s in pair]
_STACK_SNIPPETS = [s for r in CODE_RULES if r.stack for s in CODE_EXAMPLES[r.rule_id]]
_ENV_NAMES = ((".env", ""), (".env.local", ".local"), (".env.production", ".production"), ("env.local", ".local"),
              (".envrc", ""), (".env.staging", ".staging"), (".env.test", ".test"))
_TABLE_CALLS = (
    "const a = db.from('widgets').select()", "db.select().from(gadgets)", "prisma.orderLine.findMany()",
    "@Entity('ledger')", "sequelize.define('shipments', s)", "x = \"INSERT INTO audit_trail VALUES\"",
    "q.from(`tickets`)", "db.from('_hidden').select()",
)

_SALT_VALUE = "concat('v', md5(concat({p}, 'salt')), 'x')"
_IGNORES = ("node_modules\n.env\n*.pem\n*.key\n.DS_Store\n", "# nothing\ndist/\n",
            ".env*\n*.pem\n*.key\n*.p12\n*.pfx\n.DS_Store\nnode_modules/\ndocker-compose.override.yml\n.npmrc\n",
            "e\n\n  # note\n*.log\n", ".env.*\n!.env.example\n*.k*\n")
_PACKAGES = (
    '{"scripts": {"dev": "next dev -p 4100"}, "dependencies": {"next": "14", "React": "18", "prisma": "5"}}',
    '{"scripts": {"start": "PORT=5050 node ."}, "dependencies": {"vue": "3"}, "devDependencies": {"vite": "5", "vue": "3"}}',
    '{"dependencies": {"svelte": "4", "@sveltejs/kit": "2"}, "scripts": {"serve": "x --port 999", "preview": "x --port 6006"}}',
    '{"name": "empty"}',
    '{"dependencies": {"expo": "50", "graphql": "16"}, "scripts": {"postinstall": "curl x"}}',
    '{"dependencies": {"express": "4", "@trpc/server": "10"}',
)

# (modulus, remainder, path, name, ext, template) of files at the root of a project
_ROOT_FILES = [
    *[(5, i, ".gitignore", ".gitignore", "", t) for i, t in enumerate(_IGNORES) if i != 3],
    (10, 3, ".gitignore", ".gitignore", "", _IGNORES[3]),
    *[(6, i, "package.json", "package.json", ".json", t) for i, t in enumerate(_PACKAGES)],
    (4, 1, "requirements.txt", "requirements.txt", ".txt", "Django==5.0\nrequests\n"),
    (4, 2, "requirements.txt", "requirements.txt", ".txt", "flask>=3\nfastapi\n"),
    (8, 3, "pyproject.toml", "pyproject.toml", ".toml", "[project]\ndependencies = ['Flask', 'gradio']\n"),
    (7, 2, "composer.json", "composer.json", ".json",
     '{"require": {"php": "8", "laravel/framework": "11"}, "require-dev": {"symfony/framework-bundle": "7"}}'),
    (9, 4, "Cargo.toml", "Cargo.toml", ".toml", "[package]\n"),
    (4, 0, ".env.example", ".env.example", ".example", "APP_KEY=your_key\n"),
    (7, 1, ".env.vault", ".env.vault", ".vault", "VAULT_BLOB=<h40>\n"),
    (9, 1, ".env.keys", ".env.keys", ".keys", "VAULT_KEY=<h32>\n"),
    (5, 0, "prisma/schema.prisma", "schema.prisma", ".prisma",
     "datasource db {\n  provider = \"PostgreSQL\"\n  url = env(\"DATABASE_URL\")\n}\n"),
    (5, 1, "prisma/schema.prisma", "schema.prisma", ".prisma",
     "datasource db {\n  provider = 'sqlite'\n  url = 'file:./dev.db'\n}\n"),
    (10, 2, "db/schema.prisma", "schema.prisma", ".prisma", "datasource db {\n provider = \"oracle\"\n}\n"),
    (15, 7, "node_modules/p/schema.prisma", "schema.prisma", ".prisma", "provider = \"mysql\"\n"),
    (6, 1, "drizzle.config.ts", "drizzle.config.ts", ".ts", "export default { dialect: 'mysql' }\n"),
    (12, 4, "drizzle.config.js", "drizzle.config.js", ".js", "import { x } from 'drizzle-kit'\n"),
    (4, 3, "vercel.json", "vercel.json", ".json",
     '{"env": {"A": "https://<h16>.supabase.co", "B": "rediss://x.upstash.io:6379", "C": "AIza<h32>abc"}}'),
    (6, 5, "fly.toml", "fly.toml", ".toml", "url = \"postgres://a:b@h/db\"\nm = \"mongodb+srv://a:b@c.example/d\"\n"),
    (11, 5, "dist/app.config", "app.config", ".config", "mysql://hidden\n"),
]
_HEADERS = (
    "",
    "Content-Security-Policy: default-src 'self'\nX-Frame-Options: DENY\nX-Content-Type-Options: nosniff\n"
    "X-XSS-Protection: 1\nStrict-Transport-Security: max-age=63072000; includeSubDomains\n"
    "Cross-Origin-Opener-Policy: same-origin\nCross-Origin-Embedder-Policy: require-corp\n"
    "Cross-Origin-Resource-Policy: same-origin\nReferrer-Policy: no-referrer\nPermissions-Policy: camera=()",
    "content-security-policy: script-src * 'unsafe-inline'; default-src '*'\nserver: nginx/1.18",
    "Access-Control-Allow-Origin: *\nAccess-Control-Allow-Credentials: TRUE\nX-Powered-By: Express",
    "Set-Cookie: sid=1\nX-Content-Type-Options: sniff",
    "Set-Cookie: sid=1; HttpOnly; SameSite=None\nX-AspNet-Version: 4\nX-AspNetMvc-Version: 5",
    "set-cookie: a=1; secure; httponly; samesite=lax\nStrict-Transport-Security: max-age=600",
    "Strict-Transport-Security: includesubdomains; max-age=99999999999999999999",
    "CSP: no\ncontent-security-policy: script-src 'UNSAFE-EVAL'\nx-supabase: 1\nsb-gateway-version: 2",
    "X-Firebase-Locale: da\nCF-Ray: 1\ncf-cache-status: HIT\nX-Vercel-Id: x\nX-Vercel-Cache: HIT",
    "x-nf-request-id: 1\nnetlify-cache-tag: a\nx-nextjs-cache: HIT\nx-nextjs-stale-time: 1\nx-client-info: a",
    "Server: first\nserver: second\nAccess-Control-Allow-Origin:  https://own.example",
)
_BODY_LINES = (
    "", "fetch('https://<h16>.supabase.co/rest')", "key = '<jwt_long>'", "db = 'https://<h8>.firebaseio.com'",
    "k = 'AIza<h32>abc'", "n = 'https://ep-<h8>.eu.neon.tech'", "c = 'https://<h8>.convex.cloud'",
    "t = 'libsql://<h8>.turso.io'", "u = 'https://<h8>.upstash.io'", "h = 'https://<h8>.hasura.app'",
    "m = 'mongodb+srv://a:<h8>@cluster.example/db'",
)
_URLS = (
    "https://app.example.com/api/items/", "https://db.example.com/rest/v1/things?id=", "https://<h8>.supabase.co/x?",
    "https://x.firebaseio.com/a.json?n=", "https://firebase.googleapis.com/v1?", "https://<h8>.convex.cloud/q?",
    "https://a.turso.io/", "https://b.upstash.io/", "https://ep.neon.tech/", "https://app.example.com/graphql?op=",
    "https://app.example.com/trpc/list?", "https://cdn.example.com/static/app.js?v=", "https://app.example.com/?page=",
)
_CONTENT_TYPES = ("application/json", "text/html; charset=utf-8", "application/javascript", "image/png", "text/css")
_LEAKS = (
    '{"k": "sk-<h32>"}', '{"k": "sk-ant-<h32><h16>"}', '{"k": "AKIA<H16>"}', '{"apiKey": "AIza<h32>abc"}',
    "ghp_<h32>abcd ghp_<h32>abcd ghp_<h32>wxyz", "sk_live_<h32>", "whsec_<h32>", "xoxb-1-2-<h16>", "hf_<h32>ab", "npm_<h32>abcd",
    "postgres://app:<h8>@db.example/a and postgres://two:<h16>@db.example/b", "my SERVICE_ROLE key", "vercel_<h32>",
    "<jwt_long>", "https://<h16>.SUPABASE.co",
    # two tokens of one issuer: alike for longer than any prefix one might compare
    "<jwt_long>.<h8> <jwt_long>.<h16>",
)
_HEAD_PARTS = (
    '<meta name="api" content="sk-<h32>">', '<div class="x" data-key="AKIA<H16>" data-user=\'u-<h8>\' id="k"></div>',
    '<script id="__NEXT_DATA__" type="application/json">{"t": "ghp_<h32>abcd"}</script>',
    '<script>window.__NUXT__ = {"t": "hf_<h32>ab"};</script>', '<script>window.__remixContext={"t":"npm_<h32>abcd"}</script>',
    '<script>window.config = {"apiKey": "AIza<h32>abc"};</script>', '<script src="/app.js">ignored body text</script>',
    "<meta property='og:x' content='plain'><meta charset='x'>",
)

_DOCS = """(SELECT doc_id, text, source,
  CASE WHEN doc_id % 3 = 0 THEN 'monorepo'
       ELSE concat(source, '-', CAST(CAST(floor(doc_id / 100) AS BIGINT) AS STRING)) END AS project_id
  FROM documents)"""
_PROJECTS = f"(SELECT project_id, min(doc_id) AS seed FROM {_DOCS} AS d GROUP BY project_id)"


def _pick(column: str, alias: str, rows, expr: str) -> str:
    """Join a numbered list of texts on a position expression."""
    return f"JOIN {values_sql(list(enumerate(rows)), alias, alias + '_k', column)} ON {alias}.{alias}_k = {expr}"


def _files_sql() -> str:
    n, e = len(_SNIPPETS), len(ENV_LINES)
    nl = "CASE WHEN doc_id % 13 = 5 THEN concat(chr(13), chr(10)) ELSE chr(10) END"
    salt = _SALT_VALUE.format(p="project_id")
    code = f"""
      SELECT project_id, concat(folder, 'f', CAST(doc_id AS STRING), ext) AS path,
             concat('f', CAST(doc_id AS STRING), ext) AS name, ext,
             concat(text, brk, {fill_sql('s1', "concat('c', doc_id)")}, brk, CASE WHEN doc_id = 60 THEN repeat(concat(repeat('-', 99), chr(10)), 11000) ELSE '' END, '  ', {fill_sql('s2', "concat('d', doc_id)")},
                    brk, {fill_sql('s3', "concat('e', doc_id)")}, brk, s4, brk, call, brk, pinned) AS content
      FROM (SELECT d.*, {nl} AS brk,
              CASE WHEN doc_id % 11 = 0 THEN 'node_modules/x/' WHEN doc_id % 11 = 1 THEN 'dist/'
                   WHEN doc_id % 11 = 2 THEN 'app/build/api/' ELSE 'src/lib/' END AS folder,
              CASE WHEN doc_id % 37 = 0 OR doc_id % 23 = 1
                   THEN concat('const pinned = "', {salt}, '";', chr(10)) ELSE '' END AS pinned
            FROM {_DOCS} AS d) AS d
      {_pick('ext', 'x', _EXTS, f'doc_id % {len(_EXTS)}')}
      {_pick('s1', 'a', _SNIPPETS, f'doc_id % {n}')}
      {_pick('s2', 'b', _SNIPPETS, f'(doc_id * 5 + 11) % {n}')}
      {_pick('s3', 'c', _SNIPPETS, f'(doc_id * 11 + 5) % {n}')}
      {_pick('s4', 'g', _STACK_SNIPPETS, f'doc_id % {len(_STACK_SNIPPETS)}')}
      {_pick('call', 't', _TABLE_CALLS, f'doc_id % {len(_TABLE_CALLS)}')}"""
    root_env = f"""
      SELECT project_id, '.env' AS path, '.env' AS name, '' AS ext,
             concat('# settings', chr(10), 'APP_SIGNING_SALT=', {salt}, chr(10), 'NODE_ENV=production', chr(10),
                    'PUBLIC_URL=https://', substr(md5(project_id), 1, 8), '.example.com/app', chr(10),
                    'SPACED_NOTE=note of ', substr(md5(project_id), 1, 6), ' for all', chr(10),
                    {fill_sql('e1', "concat('r', project_id)")}, chr(10)) AS content
      FROM {_PROJECTS} AS p {_pick('e1', 'a', ENV_LINES, f'(seed * 7 + 3) % {e}')} WHERE seed % 5 <> 4"""
    root_local = f"""
      SELECT project_id, '.env.local' AS path, '.env.local' AS name, '.local' AS ext,
             concat('APP_SIGNING_SALT=', CASE WHEN seed % 4 = 0 THEN concat('w', md5(project_id)) ELSE {salt} END,
                    chr(10), 'COPY_OF_SALT=', {salt}, chr(10), {fill_sql('e1', "concat('l', project_id)")}, chr(10)) AS content
      FROM {_PROJECTS} AS p {_pick('e1', 'a', ENV_LINES, f'(seed * 11 + 57) % {e}')} WHERE seed % 2 = 0"""
    root = f"""
      SELECT project_id, path, name, ext, {fill_sql('template', "concat('f', project_id)")} AS content
      FROM {_PROJECTS} AS p JOIN {values_sql(_ROOT_FILES, 'r', 'modulus', 'remainder', 'path', 'name', 'ext', 'template')}
      ON p.seed % r.modulus = r.remainder"""
    package_env = f"""
      SELECT project_id, concat('packages/p', CAST(doc_id AS STRING), '/', name) AS path, name, ext,
             concat({fill_sql('e1', "concat('p', doc_id)")}, chr(10), {fill_sql('e2', "concat('q', doc_id)")}, chr(10)) AS content
      FROM {_DOCS} AS d
      JOIN {values_sql([(i, *ne) for i, ne in enumerate(_ENV_NAMES)], 'x', 'x_k', 'name', 'ext')}
        ON x.x_k = CAST(floor(doc_id / 4) AS BIGINT) % {len(_ENV_NAMES)}
      {_pick('e1', 'a', ENV_LINES, f'doc_id % {e}')} {_pick('e2', 'b', ENV_LINES, f'(doc_id * 3 + 1) % {e}')}
      WHERE doc_id % 4 = 1 OR doc_id % 4 = 2"""
    return " UNION ALL ".join(f"SELECT * FROM ({q}) AS q{i}" for i, q in enumerate((code, root_env, root_local, root, package_env)))


def _commits_sql() -> str:
    n, e = len(_SNIPPETS), len(ENV_LINES)
    heads = f"""(SELECT d.*, j.j, md5(concat(doc_id, '-', j)) AS commit_sha,
        concat('src/f', CAST(doc_id AS STRING), ext) AS path
      FROM {_DOCS} AS d JOIN {values_sql([(0,), (1,)], 'j', 'j')} ON 1 = 1
      {_pick('ext', 'x', _EXTS + ('.sh', '.env', '.txt'), f'(doc_id + j) % {len(_EXTS) + 3}')})"""
    line = {
        1: ("replace(text, chr(10), ' ')", ""),
        2: (fill_sql("s", "concat('k', doc_id, j)"), _pick('s', 'a', ENV_LINES, f'(doc_id + j * 17) % {e}')),
        3: (fill_sql("s", "concat('m', doc_id, j)"), _pick('s', 'a', _SNIPPETS, f'(doc_id * 3 + j) % {n}')),
    }
    return " UNION ALL ".join(f"""
      SELECT project_id, commit_sha, doc_id * 60 + j * 30 AS at_second, path, {no} AS line_no,
             CASE WHEN (doc_id + {no}) % 3 = 0 THEN '-' WHEN (doc_id + {no}) % 3 = 1 THEN '+' ELSE ' ' END AS change,
             {expr} AS line FROM {heads} AS h {join}""" for no, (expr, join) in line.items())


def _pages_sql() -> str:
    return f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'monorepo'
        ELSE concat('src', CAST(page_id % 20 AS STRING), '-', CAST(CAST(floor(page_id / 25) AS BIGINT) AS STRING)) END AS project_id,
      url, replace(html, '</head>', concat({fill_sql('h1', "concat('g', page_id)")}, '</head>')) AS html
      FROM pages {_pick('h1', 'a', _HEAD_PARTS, f'page_id % {len(_HEAD_PARTS)}')}"""


def _responses_sql() -> str:
    body = "replace(b1, '<jwt_long>', concat('eyJ', md5('a'), md5('b'), '.', md5('c'), md5('d'), '.', md5('e')))"
    return f"""SELECT project_id, url, 200 AS status, headers, concat(html, chr(10), {fill_sql(body, "concat('b', page_id)")}) AS body
      FROM (SELECT q.*, concat(q.raw_url, '#', CAST(q.page_id AS STRING)) AS url FROM (
             SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'monorepo'
               ELSE concat('src', CAST(page_id % 20 AS STRING), '-', CAST(CAST(floor(page_id / 25) AS BIGINT) AS STRING)) END AS project_id,
               url AS raw_url, html FROM pages) AS q) AS p
      {_pick('headers', 'a', _HEADERS, f'page_id % {len(_HEADERS)}')}
      {_pick('b1', 'b', _BODY_LINES, f'(page_id * 3 + 1) % {len(_BODY_LINES)}')}"""


def _traffic_sql() -> str:
    salt = _SALT_VALUE.format(p="project_id")
    leak = "replace(l1, '<jwt_long>', concat('eyJ', md5('a'), md5('b'), '.', md5('c'), md5('d'), '.', md5('e')))"
    return f"""
      SELECT project_id, request_id, ts, method, url, resource_type, header_block, content_type,
             CASE WHEN request_id % 97 = 5 THEN 2500000 ELSE length(body) END AS body_bytes, body
      FROM (SELECT project_id, event_id AS request_id, ts,
              CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
              concat({fill_sql('u1', "concat('u', user_id)")}, CAST(user_id % 50 AS STRING),
                     CASE WHEN event_id % 59 = 3 THEN concat('&k=', {salt}) ELSE '' END,
                     CASE WHEN event_id % 47 = 4 THEN concat('&pad=', repeat('p', 80), CAST(event_id AS STRING)) ELSE '' END) AS url,
              event_type AS resource_type,
              concat('accept: */*', chr(10), 'x-user: ', CAST(user_id AS STRING),
                     CASE WHEN event_id % 43 = 2 THEN concat(chr(10), 'authorization: Bearer ', {salt})
                          WHEN event_id % 47 = 4 THEN concat(chr(10), 'apikey: sk-', md5(concat('h', user_id))) ELSE '' END) AS header_block,
              content_type,
              concat('{{"event": "', event_type, '", "props": ', props, '}}',
                     CASE WHEN event_id = 205 THEN repeat('some longer text ', 32000) WHEN event_id = 410 THEN repeat('some longer text ', 130000) ELSE '' END,
                     CASE WHEN event_id % 41 = 0 THEN concat(chr(10), {fill_sql(leak, "concat('t', user_id)")}) ELSE '' END,
                     CASE WHEN event_id % 29 = 0 THEN concat(chr(10), 'x="', {salt}, '"') ELSE '' END,
                     CASE WHEN event_id % 31 = 0 THEN concat(chr(10), 'a note of ', substr(md5(project_id), 1, 6), ' for all') ELSE '' END) AS body
            FROM (SELECT e.*, CASE WHEN event_id % 3 = 0 THEN 'monorepo'
                    ELSE concat('src', CAST(user_id % 20 AS STRING), '-', CAST(CAST(floor(event_id / 1000) AS BIGINT) AS STRING)) END AS project_id
                  FROM events AS e) AS e
            {_pick('u1', 'a', _URLS, f'user_id % {len(_URLS)}')}
            {_pick('content_type', 'b', _CONTENT_TYPES, f'(event_id + user_id) % {len(_CONTENT_TYPES)}')}
            {_pick('l1', 'c', _LEAKS, f'user_id % {len(_LEAKS)}')}) AS t"""


_PROBE_KEYS = ("APP_SIGNING_SALT", "COPY_OF_SALT", "SUPABASE_SERVICE_ROLE_KEY", "NEXT_PUBLIC_SUPABASE_ANON_KEY", "PLAIN_ANON")


def _probes_sql() -> str:
    tables = list(CRITICAL_TABLES) + ["widgets", "gadgets", "orderline", "unknown_table"]
    cell = "md5(concat(p.project_id, table_name, key_var, combo))"
    return f"""SELECT p.project_id, table_name, key_var, combo,
        CASE WHEN substr({cell}, 1, 1) < '3' THEN 200 WHEN substr({cell}, 1, 1) < 'a' THEN 401 ELSE 403 END AS status,
        CASE WHEN substr({cell}, 2, 1) < '8' THEN 1 ELSE 0 END AS rows_returned
      FROM {_PROJECTS} AS p
      JOIN {values_sql([(t,) for t in tables], 't', 'table_name')} ON 1 = 1
      JOIN {values_sql([(k,) for k in _PROBE_KEYS], 'k', 'key_var')} ON 1 = 1
      JOIN {values_sql([(c,) for c in AUTH_COMBOS], 'c', 'combo')} ON 1 = 1"""


FIXTURE_SQL: dict[str, str] = {
    "fx_files": _files_sql(),
    "fx_commits": _commits_sql(),
    "fx_responses": _responses_sql(),
    "fx_traffic": _traffic_sql(),
    "fx_pages": _pages_sql(),
    "fx_probes": _probes_sql(),
}
_READS = {"fx_files": "documents", "fx_commits": "documents", "fx_probes": "documents", "fx_responses": "pages",
          "fx_pages": "pages", "fx_traffic": "events"}


_STORED: dict[tuple[str, str, str], str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    return new_folder(spark, "check")


class Inputs:
    """The derived tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A supplied table; one of fewer splits than cores is written out once in as many files as cores.

        A filter would move below a mere repartition, into the one task that reads the file.
        """
        given = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if given.rdd.getNumPartitions() >= cores:
            return given
        return self.stored(name, lambda: given.repartition(cores))

    def _derived(self, name: str) -> DataFrame:
        """The derived table, written once per session as files, so that a query reads a table like any other."""
        return self.stored(name, lambda: self.derive(name))

    def stored(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = f"{scratch(self.spark)}/{name}"
            write_splittable(build(), path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def derive(self, name: str) -> DataFrame:
        """The table of ``FIXTURE_SQL``. Its projects are few short rows that become many long ones, so they are dealt to all cores first."""
        source, sql = _READS[name], FIXTURE_SQL[name]
        self.table(source).createOrReplaceTempView(source)
        if _PROJECTS in sql:
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
            self.spark.sql(f"SELECT * FROM {_PROJECTS} AS p").repartition(parts).createOrReplaceTempView("fx_projects")
            sql = sql.replace(_PROJECTS, "fx_projects")
        return self.spark.sql(sql)

    @property
    def files(self) -> DataFrame:
        return self._derived("fx_files")

    @property
    def tracked(self) -> DataFrame:
        return self.files.filter(F.substring(F.md5("project_id"), 1, 1) < "8").select("project_id", "path")

    @property
    def commits(self) -> DataFrame:
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("at_second"))
        return self._derived("fx_commits").withColumn("committed_at", at).drop("at_second")

    @property
    def raw_responses(self) -> DataFrame:
        return self._derived("fx_responses")

    @property
    def responses(self) -> DataFrame:
        return self.raw_responses.withColumn("headers", parse_header_block(F.col("headers")))

    @property
    def traffic(self) -> DataFrame:
        return self._derived("fx_traffic").select(
            "project_id", "request_id", F.col("ts").cast("timestamp").alias("ts"), "method", "url", "resource_type",
            parse_header_block(F.col("header_block")).alias("request_headers"), "content_type",
            F.col("body_bytes").cast("bigint").alias("body_bytes"), "body")

    @property
    def pages(self) -> DataFrame:
        return self._derived("fx_pages")

    @property
    def probes(self) -> DataFrame:
        return self._derived("fx_probes")
