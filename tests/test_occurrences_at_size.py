"""What reaches the join does not grow with the number of values."""

from pyspark.sql import functions as F

from palisade.operators.occurrences import literal_occurrences


def measured(df, node_name, metric):
    """A metric of every node of a kind in a query that ran."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == node_name:
                out.append(node.metrics().get(metric).get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def exchanged(df):
    """Bytes of every exchange of a query that ran."""
    return measured(df, "ShuffleExchangeExec", "dataSize")


def test_many_values_do_not_send_more_of_the_texts(spark):
    values = spark.range(200_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("key-"), F.md5(F.col("id").cast("string"))).alias("value"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(249)), lambda i: F.md5(F.concat_ws("-", "id", i))), "")
    texts = spark.range(100).select(F.lit("p").alias("project_id"), "id", F.concat(text, F.when(F.col("id") == 7, F.concat(F.lit(" key-"), F.md5(F.lit("7")))).otherwise("")).alias("text"))
    found = literal_occurrences(texts, values, ["id"], broadcast=False, salts=1)
    sizes = exchanged(found)
    assert [(r.id, r.line) for r in found.collect()] == [(7, 1)]
    assert sizes and max(sizes) < 30_000_000


def test_foreign_pieces_of_a_text_become_no_rows(spark):
    values = spark.createDataFrame([("p", "note of 12345 for all"), ("p", "nøgle-æøå-ßßßß-日本語の鍵")], "project_id string, value string")
    filler = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.md5(F.concat_ws("-", "id", i))), " ")
    own = F.when(F.col("id") == 3, "\na note of 12345 for all").when(F.col("id") == 4, "\n\nx = nøgle-æøå-ßßßß-日本語の鍵!").otherwise("")
    texts = spark.range(20).select(F.lit("p").alias("project_id"), "id", F.concat(filler, own).alias("text"))
    found = literal_occurrences(texts, values, ["id"], broadcast=False, salts=1)
    rows = measured(found, "GenerateExec", "numOutputRows")
    assert {(r.id, r.line) for r in found.collect()} == {(3, 2), (4, 3)}
    assert rows and max(rows) < 1000
