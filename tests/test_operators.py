"""Semantics that the cross-checks do not reach, edge cases, and plan shapes."""

import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from palisade.checks.fixtures import Inputs
from palisade.functions.text import numbered_lines
from palisade.operators import code_scan, credentials, env_scan, http_posture, probes, repo, report, scoring
from palisade.operators.occurrences import literal_occurrences
from palisade.operators.stacks import project_stacks
from palisade.plans.fleet import Fleet, fleet_findings, fleet_report
from palisade.rules.model import rule
from palisade.schema import FINDINGS, as_findings
from palisade.sources.captures import parse_header_block
from palisade.sources.commits import recent_commits
from palisade.sources.files import read_file_tree, select_files
from palisade.sources.sinks import findings_batch_writer, read_findings, write_findings

SF = "/root/testdata/sf0.001"


def files_of(spark, *rows):
    return spark.createDataFrame(list(rows), "project_id string, path string, content string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\rc", "\n\n", "a\x0bb\x0cc\x1cd\x85e f g", "x\n\ny"])
def test_lines_are_those_of_splitlines(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(numbered_lines(F.col("t")).alias("l")).first()["l"]
    assert [(r["line"], r["text"]) for r in got] == list(enumerate(text.splitlines(), 1))


def test_profiles_prune_directories_and_keep_files_of_any_size(spark):
    files = files_of(spark, ("p", "src/a.js", "x"), ("p", "build/a.js", "x"), ("p", "a.md", "x"), ("p", "vendor/x/a.py", "x"),
                     ("p", "src/A.JS", "x"), ("p", "big.js", "x" * 1_000_001), ("p", "edge.js", "x" * 1_000_000))
    assert {r.path for r in select_files(files, "code").collect()} == {"src/a.js", "src/A.JS", "edge.js", "big.js"}
    env = files_of(spark, ("p", ".env", ""), ("p", "a/.env.local", ""), ("p", ".envrc", ""), ("p", "node_modules/.env", ""), ("p", "env.txt", ""))
    assert {r.path for r in select_files(env, "env").collect()} == {".env", "a/.env.local", ".envrc"}
    assert {r.path for r in select_files(env, "env_values").collect()} == {".env", "a/.env.local"}


def test_file_tree(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_bytes(b"caf\xc3\xa9 \xff ok\n")
    row = read_file_tree(spark, str(tmp_path)).first()
    assert (row.project_id, row.path, row.name, row.ext, row.content) == ("one", "src/a.py", "a.py", ".py", "café  ok\n")


def test_rules_that_read_the_whole_file(spark):
    race = "let a = 1;\nconst b = await getBalance(balance)\nif (b >= n) { await withdraw(n) }"
    post = '{\n"scripts": {\n "postinstall": "sh x"\n}}'
    hits = code_scan.scan_code_lines(files_of(spark, ("p", "a.js", race), ("p", "package.json", post), ("p", "b.json", post)))
    assert {(r.file, r.rule_id, r.line) for r in hits.collect()} == {("a.js", "race.balance_check", 2), ("package.json", "supply_chain.postinstall", 2)}


def test_inner_html_fires_unless_empty(spark):
    lines = "a.innerHTML = ''\nb.innerHTML=\"\"\nc.innerHTML = x\nd.innerHTML = 'y'"
    hits = code_scan.scan_code_lines(files_of(spark, ("p", "a.js", lines)))
    assert {r.line for r in hits.filter("rule_id = 'xss.inner_html'").collect()} == {3, 4}


def test_secret_evidence_is_masked(spark):
    token = "ghp_" + "a1" * 18
    found = code_scan.code_findings(files_of(spark, ("p", "a.js", f"const t = '{token}'")), project_stacks(files_of(spark, ("p", "x", ""))))
    details = [r.detail for r in found.collect()]
    assert details and not any(token in d for d in details)


def test_custom_rules(spark):
    own = (rule("own.marker", "info", r"FIXME", "marker", "FIXME"),)
    assert code_scan.scan_code_lines(files_of(spark, ("p", "a.py", "x\n# FIXME\n# FIXME")), own).count() == 2


def test_jwt_role(spark):
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    tokens = [f"{part({'alg': 'x'})}.{part({'role': r, 'pad': 'ø?>' * n})}.sig" for r, n in (("anon", 1), ("service_role", 2), ("editor", 3))]
    tokens += ["a.b", "a.!!.c", "x.e30.y"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(credentials.jwt_role(F.col("t"))).collect()
    assert [r[0] for r in got] == ["anon", "service_role", "editor", None, None, None]


def test_last_value_wins_in_order_of_listing(spark):
    files = files_of(spark, ("p", ".env", "A=first-value"), ("p", ".env.local", "A=local-value"), ("p", ".env.zzz", "A=other-value"))
    row = env_scan.last_env_value(env_scan.env_values(files)).first()
    assert (row.value, row.source) == ("local-value", ".env.local")


def test_ignore_file_may_be_missing_or_loose(spark):
    gaps = repo.ignore_coverage(files_of(spark, ("none", "a", ""), ("loose", ".gitignore", "e"), ("empty", ".gitignore", "# x\n")))
    counts = {r.project_id: r["count"] for r in gaps.groupBy("project_id").count().collect()}
    assert counts["none"] == 1 and counts["empty"] == 17 and counts["loose"] < 17
    assert gaps.filter("project_id = 'loose' AND description LIKE '%''.env''%'").count() == 0


def test_commit_limit(spark):
    rows = [("p", f"s{i:03d}", i, "a.js") for i in range(120)] + [("q", "t", 1, "a.js")]
    commits = spark.createDataFrame(rows, "project_id string, commit_sha string, committed_at long, path string")
    kept = recent_commits(commits)
    assert kept.groupBy("project_id").count().collect() and kept.count() == 51
    assert kept.agg(F.min("committed_at")).first()[0] == 1 and kept.filter("project_id = 'p'").agg(F.min("committed_at")).first()[0] == 70
    assert "WindowGroupLimit" in plan_of(kept)


def test_header_block_last_name_wins(spark):
    got = spark.createDataFrame([("A: 1\nb:  x: y \nnope\na: 2",)], "h string").select(parse_header_block(F.col("h"))).first()[0]
    assert got == {"a": "2", "b": "x: y"}


def test_hsts_with_a_huge_age(spark):
    raw = spark.createDataFrame([("p", "http://a/1", "strict-transport-security: max-age=" + "9" * 30 + "; includeSubDomains")],
                                "project_id string, url string, headers string").withColumn("headers", parse_header_block(F.col("headers")))
    assert http_posture.hsts_strength(raw).count() == 0


def occurrence_case(spark):
    values = ["abcdefghij0123456789", "abcdefghij0123456789X", "two words and some more text", "ends-with-this-long-token", "æøå-unicode-value-12345",
              "a long value " + "of many words " * 900 + "ends", "Z" * 70_000]
    texts = ["", "xxabcdefghij0123456789Xyy", "say two words and some more text!", "ends-with-this-long-token", "é æøå-unicode-value-12345 ",
             "abcdefghij012345678", "abcdefghij0123456789" * 3, "a line\nends-with-this-long-toke\nn",
             # values across the cut of a long text, after it, twice, and after line breaks of every kind around the cut
             "p" * 65_530 + "abcdefghij0123456789" + "q" * 9, "x\r\n" * 30_000 + "ends-with-this-long-token\r\n" + "y" * 70_000 + "ends-with-this-long-token",
             "l\n" * 32_767 + "r\r\n🙂 two words and some more text", "m" * 200_000 + "Z" * 70_000 + "n" * 3, "u " * 40_000 + values[5] + "."]
    owners = ("hot", "p1", "p2")
    v = spark.createDataFrame([(o, x, f"name{len(x)}") for o in owners for x in values], "project_id string, value string, name string")
    t = spark.createDataFrame([(o, i, x) for o in owners for i, x in enumerate(texts)], "project_id string, id int, text string").repartition(6)
    want = {(o, i, x, len(re.split("\r\n|\r|\n", y[:y.index(x)]))) for o in owners for i, y in enumerate(texts) for x in values if x in y}
    return t, v, want


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_occurrences_equal_brute_force(spark, broadcast):
    t, v, want = occurrence_case(spark)
    got = [(r.project_id, r.id, r.value, r.line) for r in literal_occurrences(t, v, ["id"], broadcast=broadcast).collect()]
    assert set(got) == want and len(got) == len(want)


def test_few_positions_of_texts_are_shuffled(spark, tmp_path):
    """The bitmap stands before the exchange: far fewer rows than an eighth of the texts' bytes reach the join."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = docs.select(F.col("source").alias("project_id"), "doc_id", F.translate("text", " ", "_").alias("text"))
    values = texts.groupBy("project_id").agg(F.max("text").alias("t")).select("project_id", F.substring(F.split("t", "\n")[0], 1, 24).alias("value")).where("length(value) >= 16")
    found = literal_occurrences(texts, values, ["doc_id"], broadcast=False)
    assert found.count() >= values.count() > 5
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    shuffled = [int(x) for x in re.findall(r"shuffleRecordsWritten -> (\d+)", str(node_metrics(found)))]
    assert shuffled and max(shuffled) < n_bytes / 8 / 50


def node_metrics(df):
    """Rows written by the shuffles of a query that ran."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    out, todo = [], [qe.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("shuffleRecordsWritten")
        if metric.isDefined():
            out.append(f"shuffleRecordsWritten -> {metric.get().value()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_nothing_runs_before_the_occurrences_are_used(spark):
    t, v, _ = occurrence_case(spark)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    literal_occurrences(t, v, ["id"])
    assert len(tracker.getJobIdsForGroup(None)) == before and not spark.sparkContext._jsc.getPersistentRDDs()

def findings(spark, n):
    return as_findings(spark.range(n).select(
        F.lit("p").alias("project_id"), F.when(F.col("id") % 3 == 0, "critical").otherwise("info").alias("severity"),
        F.lit("r").alias("rule_id"), F.concat(F.lit("secret "), F.col("id")).alias("description"), F.lit("a.js").alias("file"),
        F.col("id").cast("int").alias("line")), "test")


def test_scores(spark):
    projects = spark.createDataFrame([("p",), ("clean",)], "project_id string")
    card = {r.project_id: r for r in scoring.scorecard(projects, findings(spark, 6)).collect()}
    assert (card["p"].score, card["p"].failed, card["clean"].score, card["clean"].failed) == (80, True, 100, False)
    assert scoring.risk_score(projects, findings(spark, 60)).agg(F.min("score")).first()[0] == 0


def test_a_large_brief_keeps_its_order(spark):
    """Severities in order, every finding once, whole positions, however the ranges fall; a project without findings has head and tail."""
    kinds = ("info", "critical", "warning")
    rows = [("p", "x", f"r{i}", kinds[i % 3], f"secret {i:04d}", "", f"f{i % 7}.js", i) for i in range(3000)] + [("q", "x", "r", "info", "one", "", None, None)]
    found = as_findings(spark.createDataFrame(rows, "project_id string, scanner string, rule_id string, severity string, description string, detail string, file string, line int"))
    projects = spark.createDataFrame([("p",), ("q",), ("clean",)], "project_id string")
    stacks = spark.createDataFrame([("p", "React")], "project_id string, stack string")
    brief = sorted(report.remediation_brief(found.repartition(5), scoring.scorecard(projects, found), stacks).collect())
    assert [r.position for r in brief] == list(range(len(brief))) and [r.project_id for r in brief] == sorted(r.project_id for r in brief)
    text = [line for r in brief if r.project_id == "p" for line in r.text.split("\n") if line.startswith(("## ", "### "))]
    wanted = []
    for kind in ("critical", "warning", "info"):
        own = sorted((r[6], r[7], r[4]) for r in rows if r[0] == "p" and r[3] == kind)
        wanted += [f"## {report.SECTION_TITLES[kind]} (1000):", *(f"### {d}" for *_, d in own)]
    assert text == wanted
    assert sum(r.project_id == "clean" for r in brief) == 2


def test_a_project_that_lost_its_findings_has_none(spark, tmp_path):
    """A later run replaces all severities of its projects and leaves other projects alone; a run written twice counts once."""
    path, projects = str(tmp_path / "store"), lambda *names: spark.createDataFrame([(n,) for n in names], "project_id string")
    row = lambda project, severity: (project, "x", "r", severity, "d")
    table = lambda *rows: as_findings(spark.createDataFrame(list(rows), "project_id string, scanner string, rule_id string, severity string, description string"))
    write_findings(table(row("p", "critical"), row("p", "info"), row("q", "critical")), projects("p", "q"), path)
    run = write_findings(table(row("p", "info")), projects("p"), path)
    write_findings(table(row("p", "info")), projects("p"), path, run=run)
    read = lambda: sorted((r.project_id, r.severity) for r in read_findings(spark, path).collect())
    assert read() == [("p", "info"), ("q", "critical")]
    assert scoring.gate(read_findings(spark, path)).where("failed").count() == 1
    # a run that died before it named its projects is not seen
    table(row("q", "info")).write.partitionBy("severity").parquet(f"{path}/findings/run=r99999999999999999999")
    assert read() == [("p", "info"), ("q", "critical")]
    write_findings(table(row("p", "info")).limit(0), projects("p"), path)
    assert read() == [("q", "critical")]


def test_replayed_batches_replace_themselves(spark, tmp_path):
    write = findings_batch_writer(str(tmp_path / "stream"))
    for number, n in ((0, 3), (1, 2), (1, 2), (2, 5)):
        write(findings(spark, n), number)
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 10


def test_unguided_findings_have_empty_guidance(spark):
    row = report.remediation_lookup(spark.createDataFrame([("nothing known",)], "description string")).first()
    assert (row.explanation, row.remedy) == ("", "")


def test_whole_fleet(spark):
    inp = Inputs(spark, SF)
    fleet = Fleet(inp.files, inp.commits, inp.tracked, inp.responses, inp.traffic, inp.pages, inp.probes)
    found = fleet_findings(fleet)
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in FINDINGS]
    plan = plan_of(found)
    # after the shared scan only the search for environment values reads contents of the files, once
    assert sum("FileScan" in line and "fx_files" in line and "content" in line for line in plan.split("\n")) <= 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan
    counts = {r.scanner: r["count"] for r in found.groupBy("scanner").count().collect()}
    assert set(counts) >= {"env", "repo", "code", "leak", "history", "http", "datastore", "probe", "traffic"}
    tables = fleet_report(fleet, found.limit(0))
    assert set(tables) == {"scorecard", "profile", "brief"}


def test_file_filters_reach_the_scan(spark):
    files = Inputs(spark, SF).files
    text = select_files(files, "env")._jdf.queryExecution().executedPlan().toString()
    assert "In(name" in text.split("PushedFilters: [")[1]
    text = code_scan.scan_code_lines(files)._jdf.queryExecution().executedPlan().toString()
    assert "In(ext" in text.split("PushedFilters: [")[1] and "Exchange" not in text


def test_evidence_masks_secrets_of_other_rules(spark):
    line = 'const k = "sk-abcdefghijklmnopqrstuvwxyz012345"; fetch("http://plain.example/x")'
    files = spark.createDataFrame([("p", "src/a.js", line + "\n")], "project_id string, path string, content string")
    from palisade.operators.code_scan import code_findings
    found = code_findings(files, spark.createDataFrame([], "project_id string, stack string")).collect()
    assert len({r["rule_id"] for r in found}) > 1 and all("sk-abc" not in r["detail"] for r in found)


def test_tokens_that_share_a_header_are_two_exposures(spark):
    from palisade.operators.traffic import exposure_dedup, scan_text_secrets
    head = "eyJ" + "a" * 60
    text = f"{head}.{'b' * 60}.{'c' * 20} {head}.{'d' * 60}.{'e' * 20} " + "x" * 600_000
    texts = spark.createDataFrame([("p", 1, "body", "response [" + "u" * 90 + "]", text)], "project_id string, text_id long, kind string, source string, text string")
    hits = scan_text_secrets(texts)
    assert hits.count() == 2 and not any(head in str(v) for r in hits.collect() for v in r)
    assert exposure_dedup(hits.selectExpr("*", "CAST(NULL AS STRING) AS env_var")).count() == 2


def test_stream_of_exposures_keeps_no_state(spark, tmp_path):
    """A static side of any size is shuffled inside the micro-batch."""
    schema = "project_id string, text_id long, source string, text string"
    spark.createDataFrame([("p", i, "s", f"a {i} abcdefghij0123456789 b") for i in range(40)], schema).repartition(4).write.parquet(f"{tmp_path}/in")
    values = spark.createDataFrame([("p", "abcdefghij0123456789")] + [("p", f"value-number-{i:08d}") for i in range(50_000)], "project_id string, value string")
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    found = literal_occurrences(arriving, values, ["text_id", "source"], broadcast=False)
    query = found.writeStream.format("memory").queryName("exposed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("exposed").count() == 40
    assert all(not p["stateOperators"] for p in query.recentProgress) and len(query.recentProgress) >= 2
    assert not (tmp_path / "state" / "state").exists()


def test_two_tokens_of_one_variable(spark):
    """Both are reported, always the same way; a log that names the token tells them apart."""
    service = "x" * 30
    keys = spark.createDataFrame([("p", "KEY", service, "service_role", True), ("p", "KEY", "y" * 30, "anon", False)], "project_id string, var string, token string, role string, is_jwt boolean")
    tables = spark.createDataFrame([("p", "users")], "project_id string, table_name string")
    log = spark.createDataFrame([("p", "users", "KEY", "apikey-only", 200, 3), ("p", "users", "KEY", "apikey-only", 200, 7), ("p", "users", "KEY", "bearer-only", 200, 9)],
                                "project_id string, table_name string, key_var string, combo string, status int, rows_returned int")
    got = lambda df: sorted((r.key_role, r.auth_combo, r.rows_returned) for r in df.collect())
    for parts in (1, 3):
        assert got(probes.open_table_findings(keys.repartition(parts), tables, log.repartition(parts))) == [("anon", "apikey-only", 7), ("service_role", "apikey-only", 7)]
    assert got(probes.open_table_findings(keys, tables, log, "weakest")) == [("anon", "bearer-only", 9), ("service_role", "bearer-only", 9)]
    named = log.withColumn("key_hash", F.sha2(F.lit(service), 256))
    assert got(probes.open_table_findings(keys, tables, named)) == [("service_role", "apikey-only", 7)]


def test_progress_needs_no_grid(spark):
    keys = spark.range(300).selectExpr("'p' AS project_id", "concat('K', id) AS var", "concat('t', id) AS token", "'anon' AS role", "false AS is_jwt")
    tables = spark.range(300).selectExpr("'p' AS project_id", "concat('t', id) AS table_name")
    log = spark.createDataFrame([("p", "t1", "K1", "no-auth", 200, 5), ("p", "t1", "K1", "no-auth", 404, 0), ("p", "t1", "other", "no-auth", 200, 5)],
                                "project_id string, table_name string, key_var string, combo string, status int, rows_returned int")
    rows = {r.table_name: (r.n_cells, r.n_probed, r.n_left, r.n_open) for r in probes.probe_progress(keys, tables, log).collect()}
    assert len(rows) == 300 and rows["t1"] == (1200, 1, 1199, 1) and rows["t2"] == (1200, 0, 1200, 0)
    assert probes.probe_grid(keys, tables).count() == probes.probe_grid(keys, tables, salts=1).count() == 360_000
