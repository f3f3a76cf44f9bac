"""The query over token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import token_prefixes
from palisade.llm.registry import query
from palisade.llm.tables import table

#: the longest context a document may fill
TOKEN_LIMIT = 4096


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = token_prefixes.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    counted = token_prefixes.count_tokens(table(spark, sf_dir, "documents"), model, TOKEN_LIMIT, keep=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col("budget_chars").alias("limit_chars"))
