"""Environment files: variables, secret formats and names, templates and vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.matching import first_match, rule_fields
from palisade.functions.text import each, numbered_lines, strip, unquote
from palisade.rules.secrets import ENV_FORMATS, ENV_KEY_NAMES, PLACEHOLDERS
from palisade.schema import as_findings
from palisade.sources.files import projects_of, select_files

TEMPLATE_FILES = (".env.example", ".env.sample", ".env.template")
VAULT_FILES = (".env.vault", ".env.keys")

# order in which overlapping globs list a file the first and the last time; fixed values
_FIRST_LISTED = {".env": 0, "env.local": 2}
_LAST_LISTED = {".env": 0, "env.local": 2, ".env.local": 3, ".env.development": 4, ".env.production": 5,
                ".env.staging": 6, ".env.test": 7, ".env.preview": 8}


def explode_lines(files: DataFrame) -> DataFrame:
    """``project_id, path, line, text``: numbered lines (PF-1)."""
    keep = [c for c in files.columns if c != "content"]
    return (each(files, numbered_lines(F.col("content")), "_l", *keep)
            .select(*keep, F.col("_l.line").alias("line"), F.col("_l.text").alias("text")))


def _listed(ranks: dict[str, int]) -> Column:
    rank = F.lit(1)
    for name, position in ranks.items():
        rank = F.when(F.col("name") == name, F.lit(position)).otherwise(rank)
    return rank


def parse_env_pairs(lines: DataFrame) -> DataFrame:
    """``key, value`` of every ``KEY=value`` line that is no comment and has a value (PF-2)."""
    text = strip(F.col("text"))
    keep = [c for c in lines.columns if c != "text"]
    return (
        lines.withColumn("_t", text)
        .filter((F.col("_t") != "") & ~F.col("_t").startswith("#") & F.col("_t").contains("="))
        .withColumn("_kv", F.split("_t", "=", 2))
        .select(*keep, strip(F.col("_kv")[0]).alias("key"), unquote(F.col("_kv")[1]).alias("value"))
        .filter(F.col("value") != "")
    )


def is_placeholder(value: Column, min_len: int, python_format: bool) -> Column:
    v = unquote(value)
    test = (F.length(v) < min_len) | F.lower(v).isin(*PLACEHOLDERS) | (v.startswith("${") & v.endswith("}"))
    if python_format:
        test = test | (v.startswith("%(") & v.endswith(")s"))
    return test


def drop_placeholders(env_vars: DataFrame, min_len: int = 4, python_format: bool = False) -> DataFrame:
    """Without dummy values; the rule scan uses ``min_len=3, python_format=True`` (PF-3)."""
    return env_vars.filter(~is_placeholder(F.col("value"), min_len, python_format))


def env_values(files: DataFrame) -> DataFrame:
    """Variables of all environment files, with the order in which files are read.

    ``first_rank`` and ``last_rank`` order the files for "first one wins" and "last one wins".
    """
    chosen = select_files(files, "env_values")
    pairs = parse_env_pairs(explode_lines(chosen.select("project_id", "path", "name", "content")))
    return drop_placeholders(pairs).select(
        "project_id", F.col("path").alias("source"), "line", "key", "value",
        _listed(_FIRST_LISTED).alias("first_rank"), _listed(_LAST_LISTED).alias("last_rank"))


def last_env_value(env_vars: DataFrame, min_len: int = 8) -> DataFrame:
    """One row per variable: the value read last (WD-8), and where the variable was first seen."""
    last = F.struct("last_rank", "source", "line")
    first = F.struct("first_rank", "source", "line")
    return (env_vars.filter(F.length("value") >= min_len).groupBy("project_id", "key")
            .agg(F.max_by(F.struct("value", "source"), last).alias("_v"), F.min(first).alias("first_seen"))
            .select("project_id", "key", "_v.value", "_v.source", "first_seen"))


def _scan_lines(files: DataFrame) -> DataFrame:
    lines = explode_lines(select_files(files, "env").select("project_id", "path", "content"))
    text = strip(F.col("text"))
    value = F.substring(F.col("_t"), F.instr(F.col("_t"), "=") + 1, F.length("_t"))
    return (
        lines.withColumn("_t", text)
        .filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
        .filter(~(F.col("_t").contains("=") & is_placeholder(value, 3, True)))
        .select("project_id", F.col("path").alias("file"), "line", F.col("_t").alias("text"))
    )


def mask_env_line(text: Column) -> Column:
    """Evidence of an environment line: its name only, or a short start of it (PF-4)."""
    name = F.when(text.contains("="), strip(F.substring_index(text, "=", 1))).otherwise(F.substring(text, 1, 30))
    return F.concat(name, F.lit("=***"))


def _first_rule(lines: DataFrame, rules) -> DataFrame:
    return (
        lines.withColumn("rule_order", first_match(rules, "text")).filter(F.col("rule_order").isNotNull())
        .select("project_id", "file", "line", *rule_fields(rules, "rule_order"),
                mask_env_line(F.col("text")).alias("detail"))
    )


def scan_env_format(files: DataFrame, rules=ENV_FORMATS) -> DataFrame:
    """First matching value format per line (RS-2, WD-3)."""
    return _first_rule(_scan_lines(files), rules)


def scan_env_keynames(files: DataFrame, rules=ENV_KEY_NAMES) -> DataFrame:
    """First matching variable name per line (RS-3, WD-3)."""
    return _first_rule(_scan_lines(files), rules)


def env_hit_dedup(hits: DataFrame) -> DataFrame:
    """One hit per file, line and text, however often a glob listed the file (WD-2)."""
    return hits.dropDuplicates(["project_id", "file", "line", "description"])


def env_context_severity(hits: DataFrame) -> DataFrame:
    """Judge a hit by its place: fine in an environment file unless the name is public (PF-7)."""
    name = F.upper(strip(F.substring_index("detail", "=", 1)))
    text = F.replace(F.replace(F.col("description"), F.lit("hardcodet"), F.lit("fundet i .env")),
                     F.lit(" – ALDRIG i frontend"), F.lit(""))
    public = name.startswith("NEXT_PUBLIC_")
    admin = F.lower(name).contains("service_role") | F.lower(text).contains("service_role")
    note = F.when(text.contains("gitignored"), text).otherwise(
        F.concat(text, F.lit(" – sørg for at .env er gitignored")))
    return hits.select(
        *[c for c in hits.columns if c not in ("severity", "description")],
        F.when(public & admin, "critical").when(public, "warning").otherwise("info").alias("severity"),
        F.when(public & admin, "service_role nøgle med NEXT_PUBLIC_ prefix i .env – "
                               "eksponeres i klientbundlet og giver admin-adgang til databasen")
        .when(public, F.concat(text, F.lit(" – ADVARSEL: NEXT_PUBLIC_ variabler eksponeres i klientbundlet")))
        .otherwise(note).alias("description"),
        F.lit(True).alias("env_file"),
    )


def env_findings(files: DataFrame) -> DataFrame:
    """RS-2 and RS-3 over one reading of the lines, deduplicated and judged."""
    lines = _scan_lines(files)
    text = F.col("text")
    orders = F.array(first_match(ENV_FORMATS, "text"), first_match(ENV_KEY_NAMES, "text") + len(ENV_FORMATS))
    hits = (
        each(lines, F.array_compact(orders), "rule_order", "*")
        .select("project_id", "file", "line", *rule_fields(ENV_FORMATS + ENV_KEY_NAMES, "rule_order"),
                mask_env_line(text).alias("detail"))
    )
    return as_findings(env_context_severity(env_hit_dedup(hits)), "env")


def missing_env_template(files: DataFrame) -> DataFrame:
    """Projects without a template of their variables at the root (JN-13)."""
    have = files.filter(F.col("path").isin(*TEMPLATE_FILES)).select("project_id")
    missing = projects_of(files).join(have, "project_id", "left_anti")
    return as_findings(missing.select(
        "project_id", F.lit("env.missing_template").alias("rule_id"), F.lit("info").alias("severity"),
        F.lit(".env.example mangler – god praksis at have en").alias("description"),
        F.lit("Opret .env.example med placeholders for alle nødvendige variabler").alias("detail")), "env")


def vault_files(files: DataFrame) -> DataFrame:
    """Encrypted vault (fine) and its key file (not fine) at the root of a project (JN-14)."""
    keys = F.col("path") == ".env.keys"
    return as_findings(
        files.filter(F.col("path").isin(*VAULT_FILES)).select(
            "project_id",
            F.when(keys, "env.vault_keys").otherwise("env.vault").alias("rule_id"),
            F.when(keys, "critical").otherwise("info").alias("severity"),
            F.when(keys, ".env.keys fil fundet – indeholder master-krypteringsnøgler")
            .otherwise(".env.vault fundet – projekt bruger Dotenv Vault kryptering").alias("description"),
            F.when(keys, "Tilføj .env.keys til .gitignore OMGÅENDE")
            .otherwise("Husk at .env.keys ALDRIG må commites til git").alias("detail"),
            F.when(keys, F.col("path")).alias("file"),
        ), "env")
