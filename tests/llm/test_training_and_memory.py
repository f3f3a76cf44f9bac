"""The toxicity model learns from all labelled rows; encoding needs little memory."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import pieces, toxicity


def labelled(spark, n):
    docs = [(i, f"plain words {i % 17} here " + (f"awful{i % 5} nasty" if i % 3 == 0 else f"kind{i % 5} nice"), ["en", "de"][i % 2]) for i in range(n)]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3),
            spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int"))


def test_all_labelled_rows_teach(spark, monkeypatch):
    docs, labels = labelled(spark, 240)
    first = {}

    def seen(blank, counts, prior, rng, smoothing, real=toxicity.first_model):
        first["counts"], first["prior"] = counts, prior
        return real(blank, counts, prior, rng, smoothing)

    monkeypatch.setattr(toxicity, "first_model", seen)
    model = toxicity.fit_toxicity(docs, labels, F.col("doc_id") % 4 != 2, shard_documents=50)
    # every text has the word "plain", so its row counts all texts that are learned from: those of the fifths that do not calibrate
    row = toxicity.features([b"plain"], toxicity.SIZE).own[0, 0]
    held = docs.where("doc_id % 4 <> 2").where(F.pmod(F.xxhash64(F.xxhash64(F.col("doc_id").cast("string"))), F.lit(5)) == 0).count()
    assert 10 < held < 80 and first["counts"][0, :, row].sum() == 180 - held
    rows = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all((r["toxicity"] > 0.5) == bool(r["toxic"]) for r in rows) and set(model.thresholds) == {"en", "de"}
    again = toxicity.fit_toxicity(docs.repartition(7), labels.repartition(2), F.col("doc_id") % 4 != 2, shard_documents=50)
    assert np.allclose(again.one, model.one, atol=1e-5) and abs(again.scale - model.scale) < 1e-2


def test_one_label_gives_its_share(spark):
    docs, labels = labelled(spark, 60)
    model = toxicity.fit_toxicity(docs, labels.withColumn("toxic", F.lit(0)), F.lit(True), shard_documents=10)
    assert {r["toxicity"] < 0.01 for r in toxicity.score_toxicity(docs, model).collect()} == {True}


def test_encoding_needs_little_memory():
    """Segments of single letters need the most."""
    letters = [(c, i, -1.0 - i / 30) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + pieces.SPACE)]
    vocabulary = pieces.build(letters, [t.encode() for t, _, _ in letters], np.full(256, -1, np.int64), 0)
    text = "".join(np.random.default_rng(1).choice(list("abcdefghij"), 300))
    texts = [(text[i:] + text[:i]) * 10 for i in range(300)]
    tracemalloc.start()
    ids, first = pieces.encode_segments(texts, vocabulary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first[-1] == len(ids) == 900_000 and ids[:5].tolist() == ["abcdefghij".index(c) for c in text[:5]]
    assert peak < 90 * 900_000


def test_texts_are_shuffled_once_to_their_labels_and_shards(spark, monkeypatch):
    docs, labels = labelled(spark, 200)
    taken = {}

    def training(rows, shards, counts):
        taken.update(plan=rows._jdf.queryExecution().optimizedPlan().toString(), shards=shards, rows=rows.collect(), counts=counts)
        return toxicity.blank_model(0.1)

    monkeypatch.setattr(toxicity, "train_in_shards", training)
    docs = docs.union(docs.where("doc_id = 3")).union(spark.createDataFrame([(None, "no id", "en"), (9000, "no label", "en")], docs.schema))
    toxicity.fit_toxicity(docs, labels, F.col("doc_id") % 4 != 2, shard_documents=50)
    # the one join is that with the bitmap of ids, which is broadcast
    assert taken["plan"].count("Join ") == 1 and taken["shards"] == 4
    rows = sorted(taken["rows"], key=lambda r: (r["_shard"], r["_hash"], r["_id"], r["_text"] is not None, r["_text"]))
    found = [(int(r["_id"]), label) for shard in range(4) for r, label in toxicity.with_labels([r for r in rows if r["_shard"] == shard])]
    assert sorted(found) == sorted([(i, int(i % 3 == 0)) for i in range(200) if i % 4 != 2] + [(3, 1)])
    assert sum(taken["counts"].values()) == len(found) == 151


def test_changes_of_shards_are_summed_in_any_order():
    rng, size = np.random.default_rng(3), 100
    before = toxicity.first_learner(toxicity.blank_model(0.2, size))
    changes = []
    for _ in range(5):
        after = toxicity.Learner(before.model._replace(one=before.model.one.copy(), bias=float(rng.normal())), {"out": rng.random(24).astype(np.float32)}, [x.copy() for x in before.squares])
        after.model.one[rng.integers(0, size, 9)] += rng.normal(0, 0.1, (9, 4)).astype(np.float32)
        changes.append(toxicity.change(before, after))
    sent = [x for shard, c in enumerate(changes) for x in toxicity.change_blocks(shard, c, size)]
    means = [toxicity.mean_learner(before, list(toxicity.sum_changes([sent[i] for i in order], size))) for order in (range(len(sent)), rng.permutation(len(sent)))]
    want = np.zeros((size, 4))
    for c in changes:
        want[c.rows[0][0]] += c.rows[0][1] / 5
    for m in means:
        assert np.allclose(m.model.one, want, atol=1e-6) and abs(m.model.bias - np.mean([c.small["bias"] for c in changes])) < 1e-9
    assert np.array_equal(means[0].model.one, means[1].model.one) and np.array_equal(means[0].state["out"], means[1].state["out"])


def test_a_text_counts_once_for_each_of_its_rows():
    texts = [b"", b"one two one", b"two three", b"ONE", b"one " * 70] + [f"word{i} one".encode() for i in range(100)]
    labels = np.array([i % 2 for i in range(len(texts))], float)
    seen = toxicity.row_counts(texts, labels, 1 << 16)
    want = np.zeros_like(seen)
    for text, label in zip(texts, labels, strict=True):
        f = toxicity.features([text], 1 << 16)
        for t in (0, 1):
            want[t, int(label), np.unique(np.concatenate([f.own[:, t], f.gram[:, t]]))] += 1
    assert np.array_equal(seen, want) and seen[0, :, toxicity.features([b"one"], 1 << 16).own[0, 0]].sum() == 103


def test_encoding_and_decoding_do_not_share_a_task(spark):
    """Two Python workers per task took the pipeline's executors over their memory."""
    docs = spark.createDataFrame([(1, "some text ▁ here", "en", "a", 16), (2, None, "de", "b", 0), (3, "", None, "b", 0), (3, "again", "fr", None, 5)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    done = corpus_pipeline.encoded(spark, docs, "")
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {(r["doc_id"], r["n_chars"]): r for r in done.collect()}
    assert len(rows) == 4 and [rows[k]["round_trip"] for k in ((1, 16), (2, 0), (3, 0), (3, 5))] == [False, True, True, True]
    assert rows[2, 0]["n_pieces"] == 0 and len(rows[3, 5]["piece_ids"]) == rows[3, 5]["n_pieces"] > 0
