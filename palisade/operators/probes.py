"""Row-level access: which tables answer to which keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import each, lit_array
from palisade.rules.datastores import AUTH_COMBOS, CRITICAL_TABLES, QUERY_CALL_PATTERNS
from palisade.rules.profiles import PROFILES
from palisade.schema import as_findings
from palisade.sources.files import in_profile, select_files


def with_table_names(files: DataFrame) -> DataFrame:
    """Files with ``table_names``: the tables that query calls name, null outside the profile."""
    names = F.flatten(F.array(*[
        F.regexp_extract_all("content", F.lit(p), F.lit(group)) for p, group in QUERY_CALL_PATTERNS]))
    kept = F.array_distinct(F.transform(
        F.filter(names, lambda n: (F.length(n) > 1) & ~n.startswith("_")), F.lower))
    return files.withColumn("table_names", F.when(in_profile(PROFILES["query_code"]), kept))


def table_references(files: DataFrame) -> DataFrame:
    """``project_id, table_name`` of every table a query call names (AG-9)."""
    looked = files if "table_names" in files.columns else with_table_names(select_files(files, "query_code"))
    return each(looked, F.col("table_names"), "table_name", "project_id").distinct()


def tables_to_probe(projects: DataFrame, references: DataFrame) -> DataFrame:
    """Referenced tables and the ones always probed (SO-2)."""
    always = projects.select("project_id", F.explode(lit_array(CRITICAL_TABLES)).alias("table_name"))
    return references.select("project_id", F.lower("table_name").alias("table_name")).unionByName(always).distinct()


SALTS = 16
#: so many keys of a project meet so many of its tables in a task at once
BLOCK = 512


def probe_grid(credentials: DataFrame, tables: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every key of a project on each of its tables with each of four auth combinations (JN-15), as a list of what to try.

    The list is as long as its product, though a project's keys and tables are few bytes, which would pass for the work of one task. Both
    are therefore dealt to blocks, and every block of keys meets every block of tables in whichever task has the two. A block of tables is
    one row, multiplied inside its row. A project of several blocks of keys has its tables in at least ``salts`` blocks.
    What has been tried, and what is left, needs no such list: see ``probe_progress``.
    """
    combos = F.array(*[F.struct(F.lit(i).alias("combo_order"), F.lit(c).alias("combo")) for i, c in enumerate(AUTH_COMBOS)])
    own = ["project_id", "key_var", "key_role", "is_jwt"]
    keys = credentials.select("project_id", F.col("var").alias("key_var"), F.col("role").alias("key_role"), "is_jwt", F.xxhash64(*credentials.columns).alias("_h"))
    names = tables.select("project_id", F.struct("table_name").alias("_table"), F.xxhash64("table_name").alias("_h"))
    counted = [rows.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n)) for rows, n in ((keys, "_of_keys"), (names, "_of_tables"))]
    several = F.when(F.col("_of_keys") > 1, F.greatest("_of_tables", F.lit(salts))).otherwise(F.col("_of_tables"))
    sizes = counted[0].join(counted[1], "project_id").withColumn("_of_tables", several)

    key_block, table_block = F.pmod("_h", "_of_keys").alias("_key_block"), F.pmod("_h", "_of_tables").alias("_table_block")
    each_of = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias(name)
    keys = keys.join(sizes, "project_id").select(*own, key_block, each_of("_of_tables", "_table_block"))
    blocks = (names.join(sizes, "project_id").groupBy("project_id", table_block, "_of_keys").agg(F.collect_list("_table").alias("_tables"))
              .select("project_id", "_table_block", "_tables", each_of("_of_keys", "_key_block")))

    context, met = credentials.sparkSession, ["project_id", "_key_block", "_table_block"]
    parts = max(int(context.conf.get("spark.sql.shuffle.partitions")), 4 * context.sparkContext.defaultParallelism)
    cells = keys.repartition(parts, *met).join(blocks.repartition(parts, *met), met)  # partitions asked for by number are not put together
    # names are taken before the next loop, or every cell would take them again
    of_tables = cells.select(*own, F.explode("_tables").alias("_table")).select(*own, "_table.table_name")
    return of_tables.select(*own, "table_name", F.explode(combos).alias("c")).select(*own, "table_name", "c.combo_order", "c.combo")


def probe_progress(credentials: DataFrame, tables: DataFrame, probes: DataFrame) -> DataFrame:
    """Per project and table the cells of the grid, how many the log has, how many are left, and how many returned rows (JN-15).

    Keys and tables stay apart: a table has four cells per variable of its project, so cells are counted, and only those in the log
    are looked at.
    """
    own = credentials.select("project_id", F.col("var").alias("key_var")).distinct()
    n_keys = own.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_keys"))
    tried = (probes.filter(F.col("combo").isin(*AUTH_COMBOS)).groupBy("project_id", "table_name", "key_var", "combo")
             .agg(F.bool_or((F.col("status") == 200) & (F.col("rows_returned") > 0)).alias("opened"))
             .join(own, ["project_id", "key_var"], "left_semi"))
    done = tried.groupBy("project_id", "table_name").agg(F.count(F.lit(1)).alias("n_probed"), F.count_if("opened").alias("n_open"))
    cells, zero = F.col("n_keys") * len(AUTH_COMBOS), lambda c: F.coalesce(c, F.lit(0))
    return (tables.select("project_id", "table_name").join(n_keys, "project_id").join(done, ["project_id", "table_name"], "left")
            .select("project_id", "table_name", cells.alias("n_cells"), zero("n_probed").alias("n_probed"),
                    (cells - zero("n_probed")).alias("n_left"), zero("n_open").alias("n_open")))


def open_table_findings(credentials: DataFrame, tables: DataFrame, probes: DataFrame, mode: str = "first") -> DataFrame:
    """Tables that returned rows, with the auth combination that opened them (JN-16).

    ``mode="first"`` reports the first combination that worked in the order of trying, ``"weakest"`` the
    least demanding one.  Only probes that returned rows are joined, on project, table and key; the grid is
    thereby the set of its successful cells and is never written out.

    A variable may hold several tokens. A log with ``key_hash`` (SHA-256 of the token) says which one was tried; without it each
    role and kind of token of that variable is reported. Of equal cells the one with most rows counts.
    """
    order = F.array_position(lit_array(AUTH_COMBOS), F.col("combo"))
    by_token = ["key_hash"] if "key_hash" in probes.columns else []
    hits = (probes.filter((F.col("status") == 200) & (F.col("rows_returned") > 0) & (order > 0))
            .select("project_id", "table_name", "key_var", "combo", "rows_returned", order.alias("combo_order"), *by_token))
    keys = credentials.select("project_id", F.col("var").alias("key_var"), F.col("role").alias("key_role"), "is_jwt",
                              *([F.sha2("token", 256).alias("key_hash")] if by_token else [])).distinct()
    cells = (hits.join(keys, ["project_id", "key_var", *by_token])
             .join(tables.select("project_id", "table_name"), ["project_id", "table_name"], "left_semi"))
    turn = F.col("combo_order") if mode == "first" else -F.col("combo_order")
    best = (cells.groupBy("project_id", "table_name", "key_var", "key_role", "is_jwt", *by_token)
            .agg(F.min_by(F.struct("combo", "rows_returned"), F.struct(turn, -F.col("rows_returned"))).alias("b"))
            .select("project_id", "table_name", "key_var", "key_role", "is_jwt", "b.*"))
    table, var, combo, rows = F.col("table_name"), F.col("key_var"), F.col("combo"), F.col("rows_returned")
    no_auth, admin = combo == "no-auth", F.col("key_role") == "service_role"
    kind = F.when(F.col("is_jwt"), "JWT").otherwise("API-nøgle")
    text = (
        F.when(no_auth, F.concat(F.lit("🚨 TABEL '"), table, F.lit("' ÅBEN UDEN AUTH – ingen nøgle påkrævet!")))
        .when(admin, F.concat(F.lit("🚨 SERVICE_ROLE KEY ("), var, F.lit(") kan læse '"), table,
                              F.lit("' – denne nøgle er ALDRIG sikker i frontend/klient-kode")))
        .otherwise(F.concat(F.lit("RLS MANGLER på '"), table, F.lit("' – data tilgængeligt via "), var,
                            F.lit(" (role: "), F.col("key_role"), F.lit(", type: "), kind, F.lit(")"))))
    via = F.concat(var, F.lit(" via ["), combo, F.lit("] returnerer "), rows, F.lit(" rækker fra /"), table)
    detail = (
        F.when(no_auth, F.concat(F.lit("Tabellen returnerer "), rows,
                                 F.lit(" rækker UDEN nogen form for autentificering. "
                                       "Alle på internettet kan læse data. Aktiver RLS STRAKS.")))
        .when(admin, F.concat(F.lit("service_role ("), var, F.lit(") via ["), combo, F.lit("] returnerer "), rows,
                              F.lit(" rækker fra /"), table,
                              F.lit(". service_role omgår RLS og hører UDELUKKENDE i server-side kode.")))
        .otherwise(F.concat(via, F.lit(". Aktiver RLS i Supabase Dashboard → Authentication → Policies."))))
    rule = F.when(no_auth, "probe.no_auth").when(admin, "probe.service_role").otherwise("probe.anon")
    return as_findings(best.select(
        "project_id", "table_name", "key_var", "key_role", combo.alias("auth_combo"), "rows_returned",
        rule.alias("rule_id"), F.lit("critical").alias("severity"), text.alias("description"),
        detail.alias("detail")), "probe")
