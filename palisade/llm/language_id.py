"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample texts. A text is lower-cased, what is no letter becomes a
space, and the rest is cut into blocks. Every block is compressed with every dictionary, and the language with the fewest bytes
in all wins. Close decisions are marked as rejected.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.batches import DOUBLE, FLAG, TEXT, with_text_columns

UNKNOWN = "und"


class LanguageModel(NamedTuple):
    """Dictionary bytes by language, the most frequent one first: at most ``sample_texts * slice_chars`` characters each."""
    dictionaries: dict[str, bytes]
    block: int = 4096
    min_margin: float = 0.01


#: what is no letter: other than word characters, digits, and the numbers and marks that word characters include
_NO_LETTERS = regex.compile(r"[^\p{L}]+")


def letters_of(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).encode()


def fit_languages(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
                  sample_texts: int = 150, slice_chars: int = 250, max_languages: int = 200) -> LanguageModel:
    """Dictionaries from a bounded sample of the rows that ``learn`` marks.

    Per language the ``sample_texts`` texts with the smallest hash are taken, of each a slice of ``slice_chars`` characters at a place
    that the hash chooses; of more than ``max_languages`` languages the most frequent ones are learned. So no more than
    ``sample_texts * slice_chars * max_languages`` characters reach the driver. Rows without text or language teach nothing.
    """
    texts = F.col(text).cast("string")
    known = docs.where(learn & F.col(lang).isNotNull() & (F.length(texts) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string"), texts).alias("h"), texts.alias("text"))
    known = known.select("lang", "h", F.substring("text", F.pmod("h", F.greatest(F.lit(1), F.length("text") - slice_chars)).cast("int") + 1, slice_chars).alias("piece"))
    frequent = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    ranked = known.where(F.col("lang").isin(frequent)).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece")))
    pieces = defaultdict(list)
    for r in ranked.where(F.col("rank") <= sample_texts).select("lang", "h", "piece").orderBy("lang", "h", "piece").collect():
        pieces[r["lang"]].append(r["piece"])
    return LanguageModel({k: b" ".join(map(letters_of, pieces[k])) for k in frequent})


class Classifier:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.names = list(model.dictionaries)
        self.coders = []
        for content in model.dictionaries.values():
            # matches from three bytes on and small tables: texts and dictionaries are short
            how = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=14, chain_log=14, search_log=3, min_match=3, target_length=32,
                strategy=zstandard.STRATEGY_LAZY2, write_content_size=False)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: bytes) -> list[int]:
        step = self.model.block
        blocks = [text[i:i + step] for i in range(0, len(text), step)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def classify(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score (share of bytes saved against the second best) and whether the margin is too narrow."""
        letters = letters_of(text.decode("utf-8"))
        if not self.names or not letters.strip():
            return UNKNOWN, 0.0, True
        sizes = self.sizes(letters)
        order = sorted(range(len(sizes)), key=lambda i: sizes[i])
        best = sizes[order[0]]
        margin = 1.0 - best / sizes[order[1]] if len(order) > 1 else 1.0
        return self.names[order[0]], margin, margin < self.model.min_margin


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_rejected``.

    A text that is null or has no letter is ``und``, score 0, rejected; so is every text if the model has no language. Ties go to
    the language that is more frequent in the sample. Rows are independent: repeated rows get equal results, an empty table gives an empty table. The added columns
    replace columns of the same name; ``keep`` names the others that stay.
    """
    def start():
        classifier = Classifier(model)

        def compute(texts: list[bytes]) -> dict[str, list]:
            name, score, rejected = zip(*(classifier.classify(t) for t in texts), strict=True)
            return {"lang_pred": name, "lang_score": score, "lang_rejected": rejected}
        return compute

    return with_text_columns(docs, text, {"lang_pred": TEXT, "lang_score": DOUBLE, "lang_rejected": FLAG}, start, keep)
