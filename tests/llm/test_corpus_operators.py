"""Mixing, line templates, syncmers, shingle join, embedding links and the pipeline against brute force and on hard cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import embedding_links, line_templates, mixing, queries, shingle_join, syncmers, toxicity
from palisade.llm.components import components
from palisade.llm.tables import id_remainder, table
from tests.llm.cases import hard_documents, no_documents

SF = "/root/testdata/sf0.001"


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5000, 5000 + i) for i in range(1, 400)]
    df = spark.createDataFrame(links + links[:50] + [(7, 7), (None, 3)], "x long, y long").repartition(7)
    want = groups_of({n for p in links for n in p if p[0] != p[1]}, links)
    assert {r["node"]: r["component"] for r in components(df, "x", "y").collect()} == want
    assert components(df.limit(0), "x", "y").count() == 0


# mixing -----------------------------------------------------------------------------------------------------------------------

def test_schedule_keeps_every_prefix_within_one_block(spark):
    sizes = spark.createDataFrame([("sa", 0), ("sb", 10), ("sc", 10), ("n", 10)], "name string, chars long")
    rows = mixing.schedule(sizes, {"a": 5, "b": 2.5, None: 0.1}, default_weight=1, resolution=97).collect()
    period = rows[0]["period"]
    assert sorted(r["slot"] for r in rows) == list(range(period))
    share = {r["name"]: r["share"] for r in rows}
    done = Counter()
    for r in sorted(rows, key=lambda r: r["slot"]):
        assert r["turn"] == done[r["name"]]
        assert math.floor(r["turn"] * period / r["share"]) <= r["slot"] < math.ceil((r["turn"] + 1) * period / r["share"])
        done[r["name"]] += 1
        for name, a in share.items():
            assert abs(done[name] - (r["slot"] + 1) * a / period) < 1
    for bad in ({"a": 0}, {"a": float("nan")}, {"a": -1}):
        with pytest.raises(ValueError):
            mixing.schedule(sizes, bad)


def test_mixing_hard_cases(spark):
    docs = hard_documents(spark, "mix_slot,extra")
    rows = mixing.mix_sources(docs, block_chars=50, bucket_chars=30).collect()
    assert len(rows) == 13 and {r["extra"] for r in rows} == {"extra"}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for same in by.values():  # offsets are running sums of lengths
        same.sort(key=lambda r: (r["mix_offset"], len(r["text"] or "")))
        total = 0
        for r in same:
            assert r["mix_offset"] == total and r["mix_block"] == total // 50
            total += len(r["text"] or "")
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in rows)
    assert mixing.mix_sources(no_documents(spark)).count() == 0


# line templates ---------------------------------------------------------------------------------------------------------------

def lines_kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in line_templates.drop_recurring_lines(df).orderBy("doc_id").collect()]


def test_templates_generalise_and_keep_the_first(spark):
    texts = [f"User u{name} logged in from {city}\nown line number {name} of {city} text goes here" for name, city in
             (("alice", "Paris"), ("bob", "Rome"), ("carol", "Oslo"), ("dave", "Bern"))]
    texts = [t.replace("own line", w) for t, w in zip(texts, ("apple pear", "stone rock", "river lake", "cloud sky"), strict=True)]
    out = lines_kept(spark, [*texts, "Are.\nAre.", "x Are.\nAre.", "order 17 was shipped on 2024-01-02", "order 18 was shipped on 2025-11-30\nmore"])
    assert out[0] == texts[0]
    assert out[4:6] == ["Are.\nAre.", "x Are.\nAre."]
    assert out[6] == "order 17 was shipped on 2024-01-02" and out[7] == "more"


def test_lines_exact_repeats(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    out = lines_kept(spark, [f"intro one here now\n{passage}", f"{passage}\nanother end of text", passage, "one two three four\none two three four"])
    assert out == [f"intro one here now\n{passage}", "another end of text", "", "one two three four\none two three four"]


def test_lines_hard_cases(spark):
    rows = line_templates.drop_recurring_lines(hard_documents(spark, "n_lines,extra")).collect()
    assert len(rows) == 13
    first = [r for r in rows if r["doc_id"] == 1]
    assert first[0] == first[1] and first[0]["n_dropped"] == 0
    assert [r["text"] for r in rows if r["doc_id"] == 4] == [None]
    assert line_templates.drop_recurring_lines(no_documents(spark)).count() == 0


# syncmers ---------------------------------------------------------------------------------------------------------------------

def test_syncmer_query_edits_and_likeness(spark):
    docs = sorted(table(spark, SF, "documents").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in queries.SPARK["op5_syncmers"](spark, SF).collect()}
    prints = {}
    near = 0
    for i, r in enumerate(docs):
        n, after = len(r["text"]), docs[(i + 1) % len(docs)]["text"]
        edited = r["text"][:n - n // 3] + after[:n // 3]
        g = got[r["doc_id"]]
        assert g["n_chars"] == n and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(r["text"], g["fingerprint"]) == g["fingerprint"]
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        near += g["near_edited"] > g["near_next"]
    assert near >= 0.95 * len(docs)


def test_anchors_are_closed_syncmers_and_context_free(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    passage, left, right = " ".join(words[:60]), " ".join(words[60:90]), " ".join(words[90:])
    df = spark.createDataFrame([(passage,), (f"{left} {passage} {right}",), ("",), ("short one",)], "text string")
    a, b, none, short = (r["a"] for r in df.select(syncmers.anchors(F.col("text")).alias("a")).collect())
    inside = {x["hash"] for x in a}
    assert inside <= {x["hash"] for x in b} and none == [] and len(short) == 1
    symbols = [w[i:i + 4] for w in passage.split() for i in range(0, len(w), 4)]
    hashes = spark.createDataFrame([(symbols,)], "s array<string>").select(F.transform("s", lambda s: F.xxhash64(s)).alias("h"))
    h = F.col("h")
    sub = hashes.select(F.transform(F.sequence(F.lit(0), F.size(h) - 4), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(4)])).alias("m")).first()["m"]
    want = [i for i in range(len(symbols) - 9) if min(sub[i:i + 7]) in (sub[i], sub[i + 6])]
    assert [x["pos"] for x in a] == want
    pair = spark.createDataFrame([(passage, f"{left} {passage}")], "x string, y string").select(
        syncmers.shared_offsets(syncmers.anchors(F.col("x")), syncmers.anchors(F.col("y"))).alias("o")).first()["o"]
    assert len(set(pair)) == 1 and len(pair) == len(a)


def test_syncmers_hard_cases(spark):
    rows = syncmers.fingerprint_edits(hard_documents(spark, "fingerprint")).collect()
    assert len(rows) == 13 and syncmers.fingerprint_edits(no_documents(spark)).count() == 0
    one = syncmers.fingerprint_edits(hard_documents(spark).where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def test_anchors_of_a_text_serve_the_row_before(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 7 else None, f"text {i % 11} of some words " * (i % 5)) for i in range(90)] + [(3, "again"), (3, "again")], "doc_id long, text string")
    rows = syncmers.with_next_text(docs, target=8, mark=lambda c: F.struct(F.sha2(c, 256).alias("v"))).collect()
    assert len(rows) == 92 and all(r["mark"]["v"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in rows)
    assert all(r["next_mark"]["v"] == hashlib.sha256(r["next_text"].encode()).hexdigest() for r in rows)
    plain = syncmers.with_next_text(docs, target=8).select("doc_id", "text", "next_text").collect()
    assert sorted(map(repr, plain)) == sorted(repr(r) for r in syncmers.with_next_text(docs, target=8, mark=F.upper).select("doc_id", "text", "next_text").collect())
    seen = []
    monkeypatch.setattr(syncmers, "anchors", lambda c, real=syncmers.anchors: seen.append(str(c)) or real(c))
    syncmers.fingerprint_edits(docs)
    assert sorted(seen) == ["Column<'_first'>", "Column<'edited'>", "Column<'text'>"]


# shingle join -----------------------------------------------------------------------------------------------------------------

def near_texts(seed, n):
    rng = random.Random(seed)
    common = " ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(30))
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(rng.randrange(1, 90))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 3, 6))):
            w[rng.randrange(len(w))] = f"z{rng.randrange(30)}"
        out.append(" ".join(w) + (" " + common if rng.random() < 0.5 else ""))
    return out


def test_shingle_components_against_brute_force(spark):
    texts = near_texts(4, 240) + ["", None, "a b", "A  b", "a b c", "  \n"]
    df = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id long, text string").repartition(5)

    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())
    sets = {i: shingles(t) for i, t in enumerate(texts, 10)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(sets, links)
    got = {r["doc_id"]: r for r in shingle_join.shingle_components(df, tile=16).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("same", [True, False])
def test_tree_join_loses_no_pair(same):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 120)).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[:-3], rng.integers(0, 400, 3).astype(np.uint64)])) for s in sets[:80]]
    v, n = np.stack([shingle_join.counts(s, 16) for s in sets]), np.array([len(s) for s in sets])
    comp = rng.integers(0, 250, len(sets))
    half = len(sets) if same else 190
    a, b = slice(0, half), slice(0, half) if same else slice(half, None)
    pairs = {(int(i), int(j) + (0 if same else half)) for i, j in shingle_join.tree_join(v[a], n[a], comp[a], v[b], n[b], comp[b], same)}
    for i in range(half):
        for j in range(i + 1 if same else half, len(sets)):
            if comp[i] != comp[j] and shingle_join.similar(sets[i], sets[j]):
                assert (i, j) in pairs
    assert all(np.minimum(v[i], v[j]).sum() >= shingle_join.needed(n[i] + n[j]) and comp[i] != comp[j] for i, j in pairs)


def test_fine_counts_lose_no_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 40, k).astype(np.uint64)) for k in (5, 60, 300, 700, 1100, 9000, 70000)]
    sets += [np.unique(np.concatenate([s[:len(s) - len(s) // 9], rng.integers(0, 1 << 40, len(s) // 9).astype(np.uint64)])) for s in sets]
    fine, n = [shingle_join.fine_counts(s) for s in sets], np.array([len(s) for s in sets])
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(i)])
    kept = {tuple(p) for p in shingle_join.fine_admitted(fine, n, pairs).tolist()}
    assert {(i, j) for i, j in pairs.tolist() if shingle_join.similar(sets[i], sets[j])} <= kept and len(kept) < len(pairs) // 4
    assert all(np.array_equal(shingle_join.folded(f, shingle_join.GROUPS), shingle_join.counts(s)) for f, s in zip(fine, sets, strict=True))


def test_copies_that_only_their_base_links(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(104)]
    texts = [" ".join(base)]
    for k in range(60):  # 10 of 100 shingles differ from the base (90 / 110), 20 from most other copies (80 / 120)
        w = list(base)
        for at in rng.sample(range(5, 95, 6), 2):
            w[at] = f"x{k}y{at}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(3)
    assert {r["component_id"] for r in shingle_join.shingle_components(df, tile=16).collect()} == {1}


def test_shingles_hard_cases(spark):
    rows = shingle_join.shingle_components(hard_documents(spark, "n_shingles,node")).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert len(rows) == 13 and got[1] == [(8, 1)] * 2 and got[2] == [(8, 1)] and got[3] == [(0, 3)] and got[4] == [(0, 4)]
    assert {c for _, c in got[None]} == {None} and got[6] == [(1, 6)] * 2
    assert shingle_join.shingle_components(no_documents(spark)).count() == 0


# embeddings -------------------------------------------------------------------------------------------------------------------

def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 24))
    rows = []
    for i in range(300):
        v = centre[i % 12] + rng.normal(size=24) * (0.12, 0.2, 0.28)[i % 3]
        rows.append((i, [float(np.float32(x)) for x in (v if i % 10 else centre[i % 12])], int(i % 2)))
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [1.0, None], 1), (403, [float("nan")] * 24, 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (407, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(4)
    good = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = []
    for i, a in enumerate(good):
        for b in good[i + 1:]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.append((a[0], b[0]))
    count = Counter(n for p in links for n in p)
    want = groups_of([r[0] for r in rows], links)
    got = embedding_links.embedding_links(df, tile=32).collect()
    assert len(got) == len(rows) and len(links) > 200
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (count[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert embedding_links.embedding_links(df.limit(0)).count() == 0


def test_quantisation_bounds_hold_and_spare_products():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(200, 1500)) * rng.exponential(size=(200, 1))
    b = np.concatenate([a[:50] + rng.normal(size=(50, 1500)) * 0.3, rng.normal(size=(100, 1500))])
    ua, ub = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    qa, sa, da, ea = embedding_links.quantise(ua)
    qb, sb, _, eb = embedding_links.quantise(ub)
    codes = embedding_links.code_products(qa, qb)
    assert (codes == qa.astype(np.int64) @ qb.astype(np.int64).T).all()
    error = np.abs(codes * sa[:, None] * sb[None, :] - ua @ ub.T)
    assert (error <= da[:, None] * eb[None, :] + ea[:, None] + 1e-9).all()
    pair, computed = embedding_links.linked(a, b, 0.93)
    assert (pair == (ua @ ub.T >= 0.93)).all() and computed < 0.01 * pair.size


# pipeline ---------------------------------------------------------------------------------------------------------------------

def test_stages_on_their_own_input(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_jaccard_join", "mix_sources", "sentence_pieces"]
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"), id_remainder(4) != 2)
    kept = {r["doc_id"] for r in stages["toxicity"](spark, docs, SF).collect()}
    for r in docs.collect():
        score = toxicity.sigmoid(model.scale * toxicity.logits(toxicity.features([r["text"].encode()], len(model.one)), model)[0] + model.shift)
        assert (r["doc_id"] in kept) == (score < model.thresholds.get(r["lang"], model.threshold))
    out = stages["line_dedup"](spark, docs, SF)
    assert out.columns == columns and out.where("n_chars <> length(text)").count() == 0
    near = stages["ngram_jaccard_join"](spark, docs, SF)
    groups = {r["doc_id"]: r["component_id"] for r in shingle_join.shingle_components(docs).collect()}
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(d for d, c in groups.items() if d == c) and near.columns == columns
    mixed = stages["mix_sources"](spark, docs, SF)
    assert mixed.columns == columns and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, docs.collect()))
    slots = {r["doc_id"]: (r["mix_slot"], r["mix_offset"]) for r in mixing.mix_sources(docs).collect()}
    order = [slots[r["doc_id"]] for r in mixed.collect()]
    assert order == sorted(order)


def test_pipeline_hard_cases_and_run(spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hard_documents(spark, "extra"), SF)
        assert out.columns == hard_documents(spark, "extra").columns and out.count() > 0, name
        assert stage(spark, no_documents(spark), SF).count() == 0
    near = corpus_pipeline.without_near_copies(spark, hard_documents(spark), SF).collect()
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8, 9] and len(near) == 10
    done = corpus_pipeline.run(spark, SF)
    assert done.where("round_trip").count() == done.count() > 100


def test_ids_with_several_texts_are_linked_through_them(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "tu")
    cases = [([(5, t), (5, u), (6, t + " more"), (7, u + " more")], {5: 5, 6: 5, 7: 5}), ([(1, t), (5, t + " more"), (5, u)], {1: 1, 5: 1}),
             ([(3, t), (3, u), (4, u), (8, "alone " + t[::-1])], {3: 3, 4: 3, 8: 8})]
    for rows, want in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {r["doc_id"]: r["component_id"] for r in shingle_join.shingle_components(df).collect()} == want


def test_lines_of_equal_documents_recur(spark):
    text = "one line of several words here\nand a second line of words"
    rows = [(1, text), (2, text), (2, text), (3, "a line of its own words"), (None, "a row without any id here"), (None, "a row without any id here")]
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in out) == [
        (0, "a row without any id here", 0), (0, "a row without any id here", 0), (1, text, 0), (2, "", 2), (2, "", 2), (3, "a line of its own words", 0)]
