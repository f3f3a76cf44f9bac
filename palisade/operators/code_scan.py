"""Source-code rules over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.matching import file_hits, hits_column, mask_matches, rule_fields
from palisade.functions.text import strip
from palisade.rules.code import CODE_RULES
from palisade.rules.model import Rule
from palisade.rules.profiles import CODE
from palisade.schema import as_findings
from palisade.sources.files import in_profile, with_name_parts

EVIDENCE_CHARS = 120
SECRET_PACK = "hardcoded_secret"


def _applies(r: Rule) -> str:
    names = ", ".join(f"'{n}'" for n in r.extra_names)
    return f"(_code OR name IN ({names}))" if names else "_code"


def with_code_hits(files: DataFrame) -> DataFrame:
    """Files with ``code_hits``: the first line per rule of the whole table, null in files that no rule reads."""
    extra = sorted({n for r in CODE_RULES for n in r.extra_names})
    hits = hits_column(CODE_RULES, _applies, first_only=True)
    wanted = F.col("_code") | F.col("name").isin(*extra)
    return files.withColumn("_code", in_profile(CODE)).withColumn("code_hits", F.when(wanted, hits)).drop("_code")


def scan_code_lines(files: DataFrame, rules: Sequence[Rule] = CODE_RULES, first_only: bool = False) -> DataFrame:
    """Every rule on every line of the code profile (RS-1); ``rules`` may be the caller's own (EX-1).

    One pass, no shuffle: only the rules whose words a file has are tried, on the lines that hold their literals, and the first line
    per rule is taken inside the row. Hits that a shared scan has found are not looked for again.
    """
    if first_only and rules is CODE_RULES and "code_hits" in files.columns:
        found = files.select("project_id", F.col("path").alias("file"), "code_hits")
        return file_hits(found, rules, column="code_hits").select("*", *rule_fields(rules, "rule_order", ("stack",)))
    extra = sorted({n for r in rules for n in r.extra_names})
    files = with_name_parts(files).withColumn("_code", in_profile(CODE))
    # a condition that reaches the parquet scan; the directory test stands beside the hits, or Spark would fold the two into one that does not
    files = files.filter(F.col("ext").isin(*CODE.extensions) | F.col("name").isin(*extra) if extra else F.col("ext").isin(*CODE.extensions))
    hits = F.when(F.col("_code") | F.col("name").isin(*extra) if extra else F.col("_code"), hits_column(rules, _applies, first_only))
    found = files.select("project_id", F.col("path").alias("file"), hits.alias("_hits"))
    return file_hits(found, rules, column="_hits").select("*", *rule_fields(rules, "rule_order", ("stack",)))


def stack_gate(hits: DataFrame, stacks: DataFrame) -> DataFrame:
    """Keep hits of a stack's own rules only in projects that use the stack (JN-5).

    All hits pass one join, so what finds them runs once; those of no stack have no partner there, and are dealt by file.
    """
    used = stacks.select(F.col("project_id").alias("_owner"), F.col("stack").alias("_stack"), F.lit(True).alias("_used")).distinct()
    owner = F.when(F.col("stack").isNotNull(), F.col("project_id")).otherwise(F.col("file"))
    marked = hits.withColumn("_by", owner).join(used, (F.col("_by") == F.col("_owner")) & (F.col("stack") == F.col("_stack")), "left")
    return marked.where(F.col("stack").isNull() | F.col("_used")).select(*hits.columns)


def first_hit_per_file(hits: DataFrame) -> DataFrame:
    """Lowest line per file and rule (WD-1), combined before the shuffle."""
    keys = ["project_id", "file", "rule_id"]
    rest = [c for c in hits.columns if c not in keys]
    return (hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("line")).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*hits.columns))


def mask_code_lines(hits: DataFrame, rules: Sequence[Rule] = CODE_RULES) -> DataFrame:
    """``detail``: the trimmed line, 120 characters, with the secrets of every rule of the secret pack masked, whichever rule
    found the line (PF-4)."""
    own = [r for r in rules if r.pack == SECRET_PACK and r not in CODE_RULES]
    secrets = [r for r in CODE_RULES if r.pack == SECRET_PACK] + own
    return (hits.withColumn("_shown", strip(F.col("text")))
            .withColumn("detail", F.substring(mask_matches(secrets, "_shown"), 1, EVIDENCE_CHARS)).drop("_shown"))


def code_findings(files: DataFrame, stacks: DataFrame, rules: Sequence[Rule] = CODE_RULES) -> DataFrame:
    """First finding per file and rule, gated by stack."""
    hits = scan_code_lines(files, rules, first_only=True)
    if any(r.stack for r in rules):
        hits = stack_gate(hits, stacks)
    return as_findings(mask_code_lines(hits, rules), "code")
