"""License, language, secret, toxicity and piece operators against brute force on whole tables and on hard cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import language_id, licenses, pieces, queries, secret_lexing, toxicity, words
from tests.llm.cases import hard_documents, no_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_words_and_hashes():
    found = words.split_words(["Ab  c\tÄb".encode(), b"", b"x"], words.VISIBLE)
    assert [found.word(i).decode() for i in range(len(found.start))] == ["ab", "c", "Äb", "x"]
    assert found.first.tolist() == [0, 3, 3, 4]
    hashes = words.hash_spans(found.data, found.start, found.end)
    assert len(set(hashes.tolist())) == 4


# licenses ---------------------------------------------------------------------------------------------------------------------

def test_license_query_against_brute_force(spark, texts):
    phrases = [(p.split(), label) for p, label in licenses.PHRASES.items()]
    for r in queries.SPARK["op6_license_scan"](spark, SF).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = sorted((i, label) for p, label in phrases for i in range(len(found)) if found[i:i + len(p)] == p)
        assert (r["n_words"], r["n_base"]) == (len(found), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_template_markup():
    a = licenses.Automaton("<<beginOptional>>Very <<endOptional>>Big <<var;words=1..2>> License<<beginOptional>>, v2<<endOptional>>")
    match = lambda t: a.match(licenses.words_of(t))
    assert match("big fat license") == 3 and match("VERY big fat old license v2 and more") == 6
    assert match("big license") == 0 and match("big a b c license") == 0 and match("very fat license") == 0
    for bad in ("<<beginOptional>>x<<endOptional>>", "a <<beginOptional>>b"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def test_templates_in_texts():
    text = b"x. This work is licensed under the GNU General Public License, version 3. Released under the MIT License; gnu  general-public license"
    found = licenses.scan_texts([text, b""], licenses.scanner())[0]
    assert [s[0] for s in found["templates"]].count("gpl-3.0") == 2 and "mit-notice" in {s[0] for s in found["templates"]}
    assert sorted(found["base"])[-1][0] == "mit" and [b[0] for b in found["base"]].count("gpl") == 2


# secrets ----------------------------------------------------------------------------------------------------------------------

def test_secret_query_against_brute_force(spark, texts):
    for r in queries.SPARK["op10_secret_scan"](spark, SF).collect():
        t = texts[r["doc_id"]]
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in secret_lexing.ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [s[2] for s in sorted(spans)]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("literal")] == base


def found_literals(text):
    return [text[f.start:f.end] for f in secret_lexing.literal_findings(text)]


def test_assignments_and_constants():
    assert found_literals('DB_PASS = "x"\nmy_passphrase: "hunter2-Zq9!"') == ["hunter2-Zq9!"]
    assert found_literals('BASE = "s3cr3t-V4lue9"\nother = BASE\nclient_secret = other') == ["s3cr3t-V4lue9"]
    assert found_literals('{"privateKey": "abcDEF123456", "name": "abcDEF123456"}') == ["abcDEF123456"]
    assert found_literals("export SIGNING_KEY=Zx81kQ72mm\npath=/usr/lib/Zx81kQ72mm") == ["Zx81kQ72mm"]
    for clean in ("password = changeme", "token = ${TOKEN}", "secret = x", "the token: a word, see below", "if key == value99A: pass", ""):
        assert found_literals(clean) == []


def test_base_drops_after_matching():
    assert secret_lexing.base_spans("secret:token:abcdefg") == []
    assert secret_lexing.base_spans("api-key=abcdef API_KEY:'ABCDEF'") == [("assign", 15, 30)]
    assert secret_lexing.base_spans("token=abcdef0123456789abcdef0123") == [("assign", 0, 32), ("hex", 6, 32)]


# languages --------------------------------------------------------------------------------------------------------------------

def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.SPARK["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_without_letters_or_model(spark):
    model = language_id.fit_languages(hard_documents(spark), F.lit(True))
    rows = language_id.identify_languages(hard_documents(spark, "lang_pred,extra"), model).collect()
    assert len(rows) == 13 and all(r["lang_pred"] == "und" and r["lang_score"] == 0 for r in rows if r["doc_id"] in (3, 4, 7, 8))
    assert rows[0]["extra"] == "extra" and {r["lang_pred"] for r in rows} <= {"en", "de", "xx", "ja", "fr", "und"}
    none = language_id.fit_languages(no_documents(spark), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify_languages(hard_documents(spark), none).collect()} == {"und"}
    assert language_id.identify_languages(no_documents(spark), model).count() == 0


# toxicity ---------------------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(500):
        found = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        if i % 4 == 0:
            found[rng.randrange(len(found))] = "zyxwv" + rng.choice(["", "um", "ity", "ing"])
        texts.append(" ".join(found).encode())
        labels.append(float(i % 4 == 0))
    model = toxicity.train(texts[:350], np.array(labels[:350]), [["en", "de"][i // 4 % 2] for i in range(350)], size=1 << 14)
    score = toxicity.sigmoid(model.scale * toxicity.logits(toxicity.features(texts[350:], 1 << 14), model) + model.shift)
    assert ((score >= 0.3) == (np.array(labels[350:]) == 1)).mean() >= 0.97
    assert set(model.thresholds) == {"en", "de"}
    long = b" ".join(texts[351:]) + b" zyxwvity"
    apart = toxicity.logits(toxicity.features([texts[351], long], 1 << 14), model)
    together = [toxicity.logits(toxicity.features([t], 1 << 14), model)[0] for t in (texts[351], long)]
    assert np.allclose(apart, together, atol=1e-4)


def test_toxicity_hard_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = hard_documents(spark, "toxicity")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 13 and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert len({r["toxicity"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    blank = toxicity.fit_toxicity(no_documents(spark), labels, F.lit(True))
    assert toxicity.score_toxicity(no_documents(spark), blank).count() == 0


# pieces -----------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def best_score(text, scores, unknown):
    """Plain dynamic programming over all substrings."""
    text = pieces.SPACE + text.replace(" ", pieces.SPACE)
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - 16), end):
            if text[begin:end] in scores:
                best[end] = max(best[end], best[begin] + scores[text[begin:end]])
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def test_encoding_has_the_best_score_and_round_trips(vocabulary):
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=pieces.MODEL)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("the in er abc  éñ 中文 🙂\n\t<>012ÄßXYZ") for _ in range(rng.randrange(0, 30)))
        ids, _ = pieces.encode([text], vocabulary)
        assert pieces.decode(ids.tolist(), vocabulary) == text
        if text and "🙂" not in text:
            got = sum(model.get_score(int(i)) if not model.is_byte(int(i)) else 0.0 for i in ids)
            lost = sum(c not in scores for c in pieces.SPACE + text.replace(" ", pieces.SPACE))
            assert got + lost * vocabulary.unknown_score == best_score(text, scores, vocabulary.unknown_score)


def test_ties_unknowns_and_no_bytes():
    v = pieces.build([("▁", 1, -1.0), ("a", 2, -1.0), ("b", 3, -1.0), ("ab", 4, -2.0)], [b" ? ", b" ", b"a", b"b", b"ab"], np.full(256, -1, np.int64), 0)
    ids, first = pieces.encode(["ab", "", "axb"], v)
    assert ids.tolist() == [1, 4, 1, 2, 0, 3] and first.tolist() == [0, 2, 2, 6]


def test_pieces_hard_cases(spark, vocabulary):
    docs = hard_documents(spark, "piece_ids,decoded")
    found = pieces.decode_pieces(pieces.encode_pieces(docs, vocabulary), vocabulary).collect()
    assert len(found) == 13
    for r in found:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ") and r["n_pieces"] == len(r["piece_ids"])
    assert pieces.encode_pieces(no_documents(spark), vocabulary).count() == 0


def test_lists_of_ids_are_those_of_the_column():
    column = pa.array([[9], [1, 2], None, [], [3]], pa.list_(pa.int32()))
    assert [list(pieces.id_lists(c)) for c in (column, column.slice(1, 3), column.slice(5))] == [column.to_pylist(), [[1, 2], None, []], []]


def test_pieces_query_round_trips(spark):
    rows = queries.SPARK["op4_sentence_pieces"](spark, SF)
    assert rows.count() == 200 and rows.where("NOT round_trip").count() == 0


@pytest.mark.parametrize("scan", [licenses.license_scan, secret_lexing.secret_scan])
def test_scans_hard_cases(spark, scan):
    rows = scan(hard_documents(spark, "secret_spans,license_words")).collect()
    assert len(rows) == 13 and scan(no_documents(spark)).count() == 0
    same = [r for r in rows if r["doc_id"] == 1]
    assert same[0] == same[1]


def test_numbers_and_marks_are_no_letters():
    from palisade.llm import language_id
    assert language_id.letters_of("½ ²³ ① 12_٣ …").strip() == b"" and language_id.letters_of("Ça va ½ 中").split() == ["ça".encode(), b"va", "中".encode()]
