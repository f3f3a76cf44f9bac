"""Token counts of prefixes against the library, on invented texts, hard rows and a whole table."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from palisade.llm import queries, token_prefixes
from palisade.llm.tables import table
from tests.llm.cases import hard_documents, no_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the quick brown", "  ", "   ", "\n", "\t", "日本語のテキスト", "🙂", "▁", "naïve", "<s>", "</s>", "<0x0A>", "<unk>", " 12345", "hello", "aaaaaaa",
         "======", "\x00", "�", "한국어", "é", "é", "  \n  ", "ZZZ", "إلى", "----------", " a", "....", "();", "http://"]


@pytest.fixture(scope="module")
def model():
    return token_prefixes.load_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_every_prefix_and_budget_agrees_with_the_library(model, library):
    counter = token_prefixes.PrefixCounter(model)
    rng = random.Random(5)
    for k in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))
        assert counter.totals([text]) == [len(library.encode(text))], text
        if k % 15 == 0:
            want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
            assert counter.all_prefixes(text).tolist() == want
            for budget in (0, 1, 4, 11, 10**6):
                assert counter.longest_within(text, budget, want[-1]) == max(i for i, n in enumerate(want) if n <= budget)


def test_long_segments_and_forgetting(model, library, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghinorstuvé") for _ in range(n)) for n in (49, 400, 5000)] + ["a" * 3000, " " * 700, "日" * 300, "🙂" * 300]
    monkeypatch.setattr(token_prefixes, "REMEMBERED", 50)
    counter = token_prefixes.PrefixCounter(model)
    for text in texts * 2:
        assert counter.totals([text, "in between"])[0] == len(library.encode(text))
    assert counter.totals(texts) == [len(library.encode(t)) for t in texts]
    words = [f"w{rng.randrange(200)}x{rng.choice('abc')}" for _ in range(3000)]
    assert [n for i in range(0, 3000, 70) for n in counter.totals(words[i:i + 70])] == [len(library.encode(w)) for w in words]


def test_stored_counts_answer_questions(spark, model, library):
    rows = token_prefixes.prefix_counts(hard_documents(spark, "prefix_tokens,extra"), model)
    counts = F.col("prefix_tokens")
    rows = rows.select("*", token_prefixes.tokens_of_prefix(counts, F.lit(7)).alias("seven"), token_prefixes.tokens_of_prefix(counts, F.lit(10**9)).alias("all"),
                       token_prefixes.chars_within(counts, F.lit(3)).alias("three")).collect()
    assert len(rows) == 13 and {r["extra"] for r in rows} == {"extra"}
    for r in rows:
        text = r["text"] or ""
        assert r["seven"] == len(library.encode(text[:7])) and r["all"] == len(library.encode(text)) == r["prefix_tokens"][-1]
        assert r["three"] == max(i for i, n in enumerate(r["prefix_tokens"]) if n <= 3)


def test_count_tokens_hard_cases(spark, model, library):
    rows = token_prefixes.count_tokens(hard_documents(spark, "n_tokens,N_Bytes"), model, 5).collect()
    assert len(rows) == 13
    for r in rows:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
        assert len(library.encode(text[:r["budget_chars"]])) <= 5
    assert token_prefixes.count_tokens(no_documents(spark), model, 5).count() == 0


def test_query_agrees_with_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.SPARK["op13_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)
