"""The corpus pipeline: toxic documents go, recurring lines go, one of each group of near copies stays, sources are interleaved by
weight, and the texts become pieces. Each stage reads the Parquet that the one before it wrote; all but the last return the
columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm import line_templates, mixing, pieces, shingle_join, toxicity
from palisade.llm.tables import id_remainder, materialise, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language. The labels of a quarter of the ids are never learned from."""
    learn = ~F.coalesce(id_remainder(4) == 2, F.lit(False))
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.score_toxicity(docs, model).where("NOT toxicity_rejected").select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines, and their new lengths. A document goes if it lost lines and keeps none that is long enough
    to be a template."""
    kept = line_templates.drop_recurring_lines(docs)
    left = F.exists(F.split("text", "\n"), lambda line: F.size(line_templates.tokens(line)) >= line_templates.LEAST_TOKENS)
    kept = kept.where((F.col("n_dropped") == 0) | F.coalesce(left, F.lit(True)))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies; of rows that repeat an id, the first by text. Rows
    without id stay."""
    groups = materialise(shingle_join.shingle_components(docs).where("doc_id IS NOT NULL"), "groups")
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    repeated = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    marked = line_templates.maybe_in(docs, "doc_id", line_templates.bits_of(copies.union(repeated), "doc_id"))
    hit = marked.where("_maybe").drop("_maybe").join(copies, "doc_id", "left_anti")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    hit = hit.withColumn("_turn", turn).where("_turn = 1 OR doc_id IS NULL")
    return marked.where("NOT _maybe").select(*docs.columns).unionByName(hit.select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the schedule of their sources."""
    ordered = mixing.mix_sources(docs).repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
    return ordered.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text back.

    The piece ids are written before they are decoded: in one plan every task would hold two Python workers.
    """
    vocabulary = pieces.load_vocabulary()
    found = pieces.decode_pieces(materialise(pieces.encode_pieces(docs, vocabulary), "pieces"), vocabulary)
    return found.select("doc_id", "lang", "source", "n_chars", "piece_ids", "n_pieces",
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_recurring_lines),
    ("ngram_jaccard_join", without_near_copies),
    ("mix_sources", mixed),
    ("sentence_pieces", encoded),
]
#: SQL can express neither the classifier nor the encoder; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
