"""File-selection profiles: which files a scan reads.  Fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FileProfile:
    """Allow-list by extension, by name or by name prefix; directories that are pruned."""

    extensions: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    name_prefixes: tuple[str, ...] = ()
    skip_prefixes: tuple[str, ...] = ()
    excluded_dirs: tuple[str, ...] = ()


_BUILD_DIRS = ("node_modules", ".git", ".next", "dist", "build", ".turbo", "out", ".svelte-kit")
_CODE_DIRS = _BUILD_DIRS + ("__pycache__", "venv", ".venv", "vendor")
_CONFIG_NAMES = ("vercel.json", "netlify.toml", "wrangler.toml", "railway.toml", "fly.toml",
                 "docker-compose.yml", "docker-compose.yaml")
_JS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")

CODE = FileProfile(
    extensions=_JS + (".vue", ".svelte", ".py", ".php", ".rb", ".go", ".java", ".cs", ".rs", ".kt", ".scala"),
    excluded_dirs=_CODE_DIRS,
)
LITERAL = FileProfile(
    extensions=_JS + (".vue", ".svelte", ".py", ".php", ".json", ".toml", ".yaml", ".yml", ".config",
                      ".ini", ".xml", ".html", ".htm"),
    names=_CONFIG_NAMES, skip_prefixes=(".env",), excluded_dirs=_CODE_DIRS,
)
ENV = FileProfile(
    names=(".env", "env.local", ".envrc"), name_prefixes=(".env.",), excluded_dirs=("node_modules", ".git"),
)
ENV_VALUES = FileProfile(
    names=(".env", "env.local"), name_prefixes=(".env.",), excluded_dirs=("node_modules", ".git"),
)
_DATASTORE_NAMES = (".env", ".env.local", ".env.development", ".env.production", ".env.staging",
                    ".env.test", ".env.preview", ".env.vault", ".envrc", "wrangler.toml", "netlify.toml",
                    "vercel.json", "railway.toml", "fly.toml", "docker-compose.yml",
                    "docker-compose.yaml", ".npmrc")
DATASTORE = FileProfile(
    extensions=(".env", ".local") + _JS + (".json", ".toml", ".yaml", ".yml", ".config", ".ini", ".cfg"),
    names=_DATASTORE_NAMES, name_prefixes=(".env",), excluded_dirs=_BUILD_DIRS,
)
DATASTORE_NAMES = FileProfile(names=_DATASTORE_NAMES, name_prefixes=(".env",), excluded_dirs=_BUILD_DIRS)
SCHEMA = FileProfile(
    names=("schema.prisma", "drizzle.config"), name_prefixes=("drizzle.config.",), excluded_dirs=_BUILD_DIRS,
)
QUERY_CODE = FileProfile(
    extensions=_JS + (".py",),
    excluded_dirs=("node_modules", ".git", ".next", "dist", "build", ".turbo", "__pycache__"),
)

PROFILES: dict[str, FileProfile] = {
    "code": CODE, "literal": LITERAL, "env": ENV, "env_values": ENV_VALUES, "datastore": DATASTORE,
    "datastore_names": DATASTORE_NAMES, "schema": SCHEMA, "query_code": QUERY_CODE,
}
