"""Patterns that identify a datastore, by variable name, value, schema file or response.

Fixed values: patterns, technology labels, fields and hints, in catalogue order (first match wins
where the operator says so).
"""

from __future__ import annotations

# variable name -> technology; the first pattern per variable wins
KEY_NAME_PATTERNS: tuple[tuple[str, str], ...] = (
    (r"(?i)supabase.*(url|host|endpoint|anon|key|token|jwt|service)", "Supabase"),
    (r"(?i)(url|host|endpoint|anon|key|token|jwt|service).*supabase", "Supabase"),
    (r"(?i)neon.*(url|host|dsn|connection)", "Neon"),
    (r"(?i)(url|dsn|connection).*neon", "Neon"),
    (r"(?i)planetscale.*(url|host|password|token)", "PlanetScale"),
    (r"(?i)pscale.*(url|host|password|token)", "PlanetScale"),
    (r"(?i)turso.*(url|token|auth|db)", "Turso"),
    (r"(?i)(url|token|auth).*turso", "Turso"),
    (r"(?i)upstash.*(url|token|redis|rest|key)", "Upstash"),
    (r"(?i)(url|token|redis|rest).*upstash", "Upstash"),
    (r"(?i)cockroach.*(url|dsn|connection|host)", "CockroachDB"),
    (r"(?i)crdb.*(url|dsn)", "CockroachDB"),
    (r"(?i)xata.*(url|token|key|branch|api)", "Xata"),
    (r"(?i)convex.*(url|deploy|key|token)", "Convex"),
    (r"(?i)hasura.*(url|secret|key|admin|endpoint)", "Hasura"),
    (r"(?i)appwrite.*(url|endpoint|key|project|secret)", "Appwrite"),
    (r"(?i)pocketbase.*(url|host|admin|token)", "PocketBase"),
    (r"(?i)fauna.*(key|secret|token|url)", "Fauna"),
    (r"(?i)firebase.*(url|key|project|api|token|storage|auth)", "Firebase"),
    (r"(?i)(url|key|project).*firebase", "Firebase"),
    (r"(?i)(mongo|mongodb).*(uri|url|dsn|connection|host|string)", "MongoDB"),
    (r"(?i)(uri|url|dsn|host).*mongo", "MongoDB"),
    (r"(?i)(postgres|postgresql).*(url|uri|dsn|connection|host|string)", "PostgreSQL"),
    (r"(?i)(database_url|db_url|connection_string|dsn)", "Database URL"),
    (r"(?i)(mysql|mariadb).*(url|uri|dsn|host|connection)", "MySQL"),
    (r"(?i)(redis).*(url|uri|host|connection|token|tls)", "Redis"),
    (r"(?i)(mssql|sqlserver|sql_server).*(url|connection|host|dsn)", "MSSQL"),
    (r"(?i)(sqlite).*(path|file|db|url)", "SQLite"),
    (r"(?i)^(db|database)[_\-]?(url|uri|host|name|pass|password|user|string|dsn|port)$", "Database"),
    (r"(?i)^(db|database)[_\-]?(url|uri|connection)$", "Database"),
)

# file text -> technology and the field the match fills; every pattern counts
VALUE_PATTERNS: tuple[tuple[str, str, str], ...] = (
    (r"(?i)https://[a-z0-9]{8,}\.supabase\.co", "Supabase (cloud)", "url"),
    (r"(?i)https?://[a-z0-9\-\.]+\.[a-z]{2,}.*supabase", "Supabase (self-hosted)", "url"),
    (r"eyJ[A-Za-z0-9_\-]{50,}\.[A-Za-z0-9_\-]{50,}\.[A-Za-z0-9_\-]{10,}", "Supabase/JWT key", "anon_key"),
    (r"(?i)https?://[a-z0-9\-]+\.[a-z]{2,}\.neon\.tech", "Neon (serverless Postgres)", "url"),
    (r"(?i)postgresql?://[^\s\"']+@[^\s\"']*\.neon\.tech", "Neon connection string", "url"),
    (r"(?i)mysql://[^\s\"']+@[^\s\"']*\.psdb\.cloud", "PlanetScale", "url"),
    (r"(?i)pscale://[^\s\"']+", "PlanetScale", "url"),
    (r"(?i)libsql://[^\s\"']+\.turso\.io", "Turso", "url"),
    (r"(?i)https?://[^\s\"']+\.turso\.io", "Turso", "url"),
    (r"(?i)rediss?://[^\s\"']*\.upstash\.io", "Upstash Redis", "url"),
    (r"(?i)https?://[^\s\"']+\.upstash\.io", "Upstash REST", "url"),
    (r"(?i)postgresql?://[^\s\"']+\.cockroachlabs\.cloud", "CockroachDB", "url"),
    (r"(?i)https?://[^\s\"']+\.xata\.sh", "Xata", "url"),
    (r"(?i)https?://[^\s\"']+\.convex\.cloud", "Convex", "url"),
    (r"(?i)https?://[^\s\"']+\.(hasura\.app|hasura\.io)", "Hasura", "url"),
    (r"(?i)https?://[^\s\"']+\.appwrite\.io", "Appwrite", "url"),
    (r"(?i)https?://[^\s\"']+\.(firebaseio|firebase\.google)\.com", "Firebase", "url"),
    (r"AIza[0-9A-Za-z\-_]{35}", "Firebase API Key", "firebase_api_key"),
    (r"(?i)mongodb(\+srv)?://[^\s\"']+", "MongoDB", "mongodb_url"),
    (r"(?i)postgresql?://[^\s\"']+", "PostgreSQL", "postgres_url"),
    (r"(?i)mysql://[^\s\"']+", "MySQL", "mysql_url"),
    (r"(?i)mariadb://[^\s\"']+", "MariaDB", "mariadb_url"),
    (r"(?i)rediss?://[^\s\"']+", "Redis", "redis_url"),
    (r"(?i)sqlserver://[^\s\"']+", "MS SQL Server", "mssql_url"),
    (r"(?i)mssql://[^\s\"']+", "MS SQL Server", "mssql_url"),
    (r"(?i)https?://fauna\.com|fnAETA[A-Za-z0-9_\-]+", "Fauna", "url"),
)

ORM_PROVIDERS: dict[str, str] = {
    "postgresql": "PostgreSQL (Prisma)",
    "postgres": "PostgreSQL (Prisma)",
    "mysql": "MySQL (Prisma)",
    "sqlite": "SQLite (Prisma)",
    "sqlserver": "MS SQL Server (Prisma)",
    "mongodb": "MongoDB (Prisma)",
    "cockroachdb": "CockroachDB (Prisma)",
}
ORM_PROVIDER_PATTERN = r"provider\s*=\s*[\"']([a-zA-Z]+)[\"']"
ORM_URL_ENV_PATTERN = r"url\s*=\s*env\([\"']([^\"']+)[\"']\)"
ORM_URL_PATTERN = r"url\s*=\s*[\"']([^\"']+)[\"']"
DIALECT_PATTERN = r"dialect\s*[:=]\s*[\"']([a-zA-Z]+)[\"']"

# response body -> technology, in priority order, and the keys read from it
BODY_TYPE_PATTERNS: tuple[tuple[str, str], ...] = (
    (r"(?i)https://[a-z0-9]{4,}\.supabase\.co", "Supabase"),
    (r"eyJ[A-Za-z0-9_\-]{50,}\.[A-Za-z0-9_\-]{50,}\.[A-Za-z0-9_\-]{10,}", "Supabase"),
    (r"(?i)https://[a-z0-9\-]+\.firebaseio\.com", "Firebase"),
    (r"AIza[0-9A-Za-z\-_]{35}", "Firebase"),
    (r"(?i)https?://[a-z0-9\-]+\.[a-z]+\.neon\.tech", "Neon"),
    (r"(?i)https?://[a-z0-9\-]+\.convex\.cloud", "Convex"),
    (r"(?i)libsql://[a-z0-9\-]+\.turso\.io", "Turso"),
    (r"(?i)https?://[a-z0-9\-]+\.upstash\.io", "Upstash"),
    (r"(?i)https?://[a-z0-9\-]+\.(hasura\.app|hasura\.io)", "Hasura"),
    (r"(?i)mongodb(\+srv)?://[^\s\"'<>]+", "MongoDB"),
)
HEADER_TYPES: tuple[tuple[str, str], ...] = (
    ("x-client-info", "Supabase"), ("sb-gateway-version", "Supabase"), ("x-supabase", "Supabase"),
    ("x-firebase-appcheck", "Firebase"), ("x-firebase-locale", "Firebase"),
)

# hint key -> (severity, text, advice); the first key contained in a technology name wins
HINTS: tuple[tuple[str, str, str, str], ...] = (
    ("MongoDB", "warning", "MongoDB fundet – tjek at autentificering er aktiveret (--auth flag)",
     "Ingen auth = komplet åben database"),
    ("MongoDB", "info", "MongoDB – sørg for at bruge TLS/SSL forbindelser", ""),
    ("PostgreSQL", "info", "PostgreSQL fundet – tjek at SSL er aktiveret (sslmode=require)",
     "Brug sslmode=require i forbindelsesstrengen"),
    ("MySQL", "info", "MySQL fundet – tjek at brugere har mindst-privilegier",
     "Undgå root-bruger i applikationskode"),
    ("MariaDB", "info", "MariaDB fundet – tjek at brugere har mindst-privilegier", ""),
    ("Redis", "warning",
     "Redis fundet – tjek at adgangskode er sat (requirepass) og at Redis ikke er eksponeret uden for localhost",
     "Redis uden auth er fuldstændig åben"),
    ("Upstash Redis", "info", "Upstash Redis fundet – tjek at REST token ikke er eksponeret i klientkode", ""),
    ("MSSQL", "info", "MS SQL Server fundet – tjek at SQL Server Auth er konfigureret korrekt", ""),
    ("Turso", "info", "Turso SQLite Edge fundet – tjek at auth token ikke er eksponeret", ""),
    ("Neon", "info", "Neon serverless Postgres fundet – tjek at connection pooling er konfigureret", ""),
    ("PlanetScale", "info", "PlanetScale fundet – tjek at branch-kodeord ikke er committed til git", ""),
    ("CockroachDB", "info", "CockroachDB fundet – tjek at TLS krav er opfyldt", ""),
    ("Hasura", "warning", "Hasura fundet – tjek at admin secret er sat og ikke eksponeret",
     "HASURA_GRAPHQL_ADMIN_SECRET skal holdes hemmelig"),
    ("Convex", "info", "Convex fundet – tjek at deployment key ikke er i frontend-kode", ""),
    ("Firebase", "warning", "Firebase fundet – tjek Firestore Security Rules og Firebase Storage Rules",
     "Åbne rules = alle kan læse/skrive alle data"),
)
HINT_KEYS: tuple[str, ...] = tuple(dict.fromkeys(h[0] for h in HINTS))

# tables always probed, query-call patterns (pattern, group of the table name), and auth combinations
CRITICAL_TABLES: tuple[str, ...] = (
    "users", "profiles", "user_profiles", "accounts", "orders", "payments", "transactions", "invoices",
    "messages", "notifications", "chats", "admin", "admins", "roles", "permissions", "secrets", "tokens",
    "sessions", "api_keys", "subscriptions", "plans", "personal_data", "kyc", "documents", "audit_logs",
    "logs", "products", "inventory", "comments", "posts", "content",
)
QUERY_CALL_PATTERNS: tuple[tuple[str, int], ...] = (
    (r"\.from\(['\"]([a-zA-Z0-9_]+)['\"]\)", 1),
    (r"\.from\(`([a-zA-Z0-9_]+)`\)", 1),
    (r"prisma\.([a-zA-Z0-9_]+)\.(find|create|update|delete|upsert|count|aggregate)", 1),
    (r"db\.(select|insert|update|delete)\([^)]*\)\.from\(([a-zA-Z0-9_]+)\)", 2),
    (r"(?i)(?:FROM|INTO|UPDATE|TABLE)\s+[`'\"]?([a-zA-Z0-9_]+)[`'\"]?\s", 1),
    (r"@Entity\(['\"`]([a-zA-Z0-9_]+)['\"`]\)", 1),
    (r"sequelize\.define\(['\"]([a-zA-Z0-9_]+)['\"]", 1),
)
AUTH_COMBOS: tuple[str, ...] = ("apikey+bearer", "apikey-only", "bearer-only", "no-auth")
