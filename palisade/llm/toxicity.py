"""Toxicity by a convolutional text classifier, trained and applied in numpy.

A word's vector is the sum of two rows of hashed embedding tables for the word itself, plus the element-wise largest such sum over
its byte n-grams and beginnings, so that unseen endings of a known stem count. Filters over one, two and three words slide over the whole
text; the largest response of each filter goes to a logistic output. Scores are calibrated by Platt's method on texts that were not
trained on; the threshold of a decision is fitted for each language, which is no input of the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.batches import DOUBLE, with_text_columns
from palisade.llm.line_templates import bits_of, maybe_in
from palisade.llm.words import ALPHANUMERIC, Words, hash_spans, mix, powers, split_words

GRAMS = (4, 5)
BEGINNINGS = (4, 5, 6, 7, 8)
WIDTHS = (1, 2, 3)
_SECOND = np.uint64(0xD6E8FEB86659FD93)
#: rows of each table, passes over the texts, texts of a step, size of a step, weight of the prior, and where the random numbers begin
SIZE, EPOCHS, BATCH_DOCS, RATE, SMOOTHING, SEED = 1 << 18, 4, 64, 0.05, 10.0, 7
#: cells of the histogram of scores, before calibration, for a difference of 1
BINS = 256


class ToxicityModel(NamedTuple):
    one: np.ndarray
    two: np.ndarray
    filters: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    scale: float
    shift: float
    thresholds: dict[str, float]
    threshold: float


class Batch(NamedTuple):
    """``word``: unique word of each token. Rows of the tables: ``own`` by word, ``gram`` by gram, grams of word i from ``into[i]`` on."""
    word: np.ndarray
    first: np.ndarray
    own: np.ndarray
    gram: np.ndarray
    into: np.ndarray


def rows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Two table rows for each hash."""
    # a remainder by a power of two are its lowest bits
    rest = (lambda h: h & np.uint64(size - 1)) if size & (size - 1) == 0 else (lambda h: h % np.uint64(size))
    return np.stack([rest(hashes), rest(mix(hashes ^ _SECOND))], 1).astype(np.int64)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, and which of them stands at every place."""
    order = np.argsort(hashes)
    run = hashes[order]
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    which = np.empty(len(run), np.int64)
    which[order] = np.cumsum(new) - 1
    return run[new], order[new], which


def features(texts: list[bytes], size: int) -> Batch:
    found: Words = split_words(texts, ALPHANUMERIC)
    hashes = hash_spans(found.data, found.start, found.end)
    unique, at, word = distinct(hashes)
    start, length = found.start[at], (found.end - found.start)[at]
    # every word's grams stand together: the word itself, its grams by length, its beginnings
    count = 1 + sum(np.maximum(length - n + 1, 0) for n in GRAMS) + sum((length > n).astype(np.int64) for n in BEGINNINGS)
    into = np.cumsum(count) - count
    gram, room = np.zeros(int(count.sum()), np.uint64), into + 1
    gram[into] = unique
    data = found.data.astype(np.uint64) + np.uint64(1)
    for n in GRAMS:
        long = np.flatnonzero(length >= n)
        if not len(long):
            continue
        count = length[long] - n + 1
        shift = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(start[long], count) + shift
        p, value = powers(n), np.full(len(place), np.uint64(n) << np.uint64(32))
        for j in range(n):
            value += data[place + j] * p[j]
        gram[np.repeat(room[long], count) + shift] = mix(value)
        room[long] += count
    for n in BEGINNINGS:
        long = np.flatnonzero(length > n)
        if len(long):
            gram[room[long]] = mix(hash_spans(found.data, start[long], start[long] + n) + np.uint64(n))
            room[long] += 1
    return Batch(word, found.first, rows_of(unique, size), rows_of(gram, size), into)


def word_vectors(batch: Batch, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """One row per unique word and a row of zeros for padding."""
    vectors = np.zeros((len(batch.own) + 1, one.shape[1]), np.float32)
    if len(batch.own):
        grams = one[batch.gram[:, 0]] + two[batch.gram[:, 1]]
        vectors[:-1] = one[batch.own[:, 0]] + two[batch.own[:, 1]] + np.maximum.reduceat(grams, batch.into, axis=0)
    return vectors


def padded(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with padding between them; first and end place of each text (an empty text has one padding token)."""
    count = np.diff(batch.first)
    gap = max(WIDTHS) - 1
    room = np.maximum(count, 1) + gap
    begin = np.cumsum(room) - room
    tokens = np.full(int(room.sum()), len(batch.own), np.int64)
    if len(batch.word):
        tokens[np.repeat(begin - batch.first[:-1], count) + np.arange(len(batch.word))] = batch.word
    return tokens, begin, begin + np.maximum(count, 1)


def responses(x: np.ndarray, weights: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Filter responses at each place; ``x`` ends with enough padding."""
    n = len(x) - len(weights) + 1
    z = x[:n] @ weights[0]
    for o in range(1, len(weights)):
        z += x[o:o + n] @ weights[o]
    z += offset
    return z


def logits(batch: Batch, model: ToxicityModel) -> np.ndarray:
    tokens, begin, end = padded(batch)
    x = word_vectors(batch, model.one, model.two)[tokens]
    cuts = np.stack([begin, end], 1).ravel()
    pooled = []
    for k in WIDTHS:
        z = responses(x, model.filters[k], model.offsets[k])
        pooled.append(np.maximum(np.maximum.reduceat(z, np.minimum(cuts, len(z) - 1), axis=0)[::2], 0.0))
    return np.concatenate(pooled, 1) @ model.out + model.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def blank_model(share: float, size: int = SIZE, dims: int = 4, maps: int = 8) -> ToxicityModel:
    """Every score is the share of label 1."""
    return ToxicityModel(
        np.zeros((size, dims), np.float32), np.zeros((size, dims), np.float32), {k: np.zeros((k, dims, maps), np.float32) for k in WIDTHS},
        {k: np.zeros(maps, np.float32) for k in WIDTHS}, np.zeros(len(WIDTHS) * maps, np.float32), 0.0, 1.0,
        float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), {}, 0.3)


def row_counts(texts: list[bytes], labels: np.ndarray, size: int) -> np.ndarray:
    """Texts of each label that have each row of each table."""
    seen = np.zeros((2, 2, size), np.float32)
    for at in range(0, len(texts), BATCH_DOCS):
        f = features(texts[at:at + BATCH_DOCS], size)
        end = np.append(f.into[1:], len(f.gram))
        for i, label in enumerate(labels[at:at + BATCH_DOCS]):
            word = np.unique(f.word[f.first[i]:f.first[i + 1]])
            count = end[word] - f.into[word]
            gram = np.repeat(f.into[word] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            for t in (0, 1):
                seen[t, int(label), np.concatenate([f.own[word, t], f.gram[gram, t]])] += 1  # a row that a text has twice counts once
    return seen


def first_model(blank: ToxicityModel, seen: np.ndarray, prior: float, rng: np.random.Generator, smoothing: float) -> ToxicityModel:
    """Smoothed log-odds of each table row, by documents, are the first coordinate of the embeddings."""
    (size, dims), maps, tables = blank.one.shape, len(blank.offsets[1]), []
    for t in (0, 1):
        odds = np.log((seen[t, 1] + smoothing * prior) / (seen[t, 0] + smoothing * (1 - prior)) * (1 - prior) / prior)
        table = rng.normal(0, 0.02, (size, dims)).astype(np.float32)
        table[:, 0] += 0.5 * odds
        tables.append(table)
    return blank._replace(
        one=tables[0], two=tables[1], shift=0.0,
        filters={k: (rng.normal(0, 0.1, (k, dims, maps)) + np.eye(1, dims)[:, :, None] * 0.4 / k).astype(np.float32) for k in WIDTHS},
        offsets={k: np.linspace(-2.5, -0.5, maps).astype(np.float32) for k in WIDTHS},
        out=np.full(len(WIDTHS) * maps, 0.2, np.float32), bias=float(np.log(prior / (1 - prior))))


class Learner(NamedTuple):
    """A model and the sums of squared gradients that set its steps: of the small arrays by name, and of the rows of both tables."""
    model: ToxicityModel
    state: dict[str, np.ndarray]
    squares: list[np.ndarray]


def first_learner(model: ToxicityModel) -> Learner:
    return Learner(model, {}, [np.full(len(model.one), 1e-2, np.float32) for _ in range(2)])


def epoch(learner: Learner, texts: list[bytes], labels: np.ndarray, chosen: np.ndarray, rate: float, batch_docs: int) -> Learner:
    """One pass over the chosen texts in their order. The tables and their squares are changed in place."""
    model, state, squares = learner.model, dict(learner.state), learner.squares
    size, dims = model.one.shape
    maps = len(model.offsets[1])

    def step(name: str, value: np.ndarray, grad: np.ndarray, lr: float) -> np.ndarray:
        state[name] = state.get(name, 1e-2) + grad * grad
        return (value - lr * grad / np.sqrt(state[name])).astype(np.float32)

    for at in range(0, len(chosen), batch_docs):
        part = chosen[at:at + batch_docs]
        f = features([texts[i] for i in part], size)
        tokens, begin, end = padded(f)
        vectors = word_vectors(f, model.one, model.two)
        x = vectors[tokens]
        places, pooled = {}, []
        for k in WIDTHS:
            z = responses(x, model.filters[k], model.offsets[k])
            places[k] = np.stack([b + z[b:e].argmax(0) for b, e in zip(begin, np.minimum(end, len(z)), strict=True)])
            pooled.append(np.take_along_axis(z, places[k], 0))
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        wrong = (sigmoid(hidden @ model.out + model.bias) - labels[part]).astype(np.float32) / len(part)
        back = wrong[:, None] * model.out[None, :] * (raw > 0)
        d_words = np.zeros_like(vectors)
        filters, offsets = {}, {}
        for n, k in enumerate(WIDTHS):
            g = back[:, n * maps:(n + 1) * maps]
            d_filter = np.zeros_like(model.filters[k])
            for o in range(k):
                at_word = tokens[places[k] + o]
                d_filter[o] = np.einsum("bm,bmd->dm", g, vectors[at_word])
                np.add.at(d_words, at_word, g[:, :, None] * model.filters[k][o].T[None])
            filters[k] = step(f"f{k}", model.filters[k], d_filter, rate)
            offsets[k] = step(f"o{k}", model.offsets[k], g.sum(0), rate)
        out = step("out", model.out, hidden.T @ wrong, rate)
        bias = float(step("bias", np.float32(model.bias), wrong.sum(), rate))
        moved = np.flatnonzero(np.abs(d_words[:-1]).sum(1) > 0)
        for t, table in enumerate((model.one, model.two)):
            rows = f.own[moved, t]
            np.add.at(squares[t], rows, (d_words[moved] ** 2).sum(1))
            np.add.at(table, rows, -rate * d_words[moved] / np.sqrt(squares[t][rows])[:, None])
        for w in moved:  # the gram that gave the largest value of each coordinate moves
            g = slice(f.into[w], f.into[w + 1] if w + 1 < len(f.into) else len(f.gram))
            rows = f.gram[g]
            best = (model.one[rows[:, 0]] + model.two[rows[:, 1]]).argmax(0)
            for t, table in enumerate((model.one, model.two)):
                hit = rows[best, t]
                table[hit, np.arange(dims)] -= rate * d_words[w] / np.sqrt(squares[t][hit] + d_words[w] ** 2)
        model = model._replace(filters=filters, offsets=offsets, out=out, bias=bias)
    return Learner(model, state, squares)


def train(texts: list[bytes], labels: np.ndarray, langs: list[str | None], size: int = SIZE, dims: int = 4, maps: int = 8,
          epochs: int = EPOCHS, batch_docs: int = BATCH_DOCS, rate: float = RATE, smoothing: float = SMOOTHING, seed: int = SEED) -> ToxicityModel:
    """Fit on texts of one shard; a fifth of them calibrates. Without both labels every score is the share of label 1."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    blank = blank_model(share, size, dims, maps)
    if not 0 < share < 1:
        return blank
    order = rng.permutation(len(texts))
    held, learned = order[: len(order) // 5], order[len(order) // 5:]
    if len(set(labels[learned])) < 2 or len(set(labels[held])) < 2:
        held = learned = order
    seen = row_counts([texts[i] for i in learned], labels[learned], size)
    learner = first_learner(first_model(blank, seen, labels[learned].mean(), rng, smoothing))
    for _ in range(epochs):
        learner = epoch(learner, texts, labels, rng.permutation(learned), rate, batch_docs)
    model = learner.model
    scores = np.concatenate([logits(features([texts[i]], size), model) for i in held])
    scale, shift = platt(scores, labels[held])
    model = model._replace(scale=scale, shift=shift)
    final = sigmoid(scale * np.concatenate([logits(features([t], size), model) for t in texts]) + shift)
    thresholds = {}
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if own.sum() >= 20 and 3 <= labels[own].sum() < own.sum():
            thresholds[lang] = best_threshold(final[own], labels[own])
    return model._replace(thresholds=thresholds)


def platt(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept by Newton steps on smoothed targets; a weight says how many texts have a score and label."""
    weights = np.ones(len(scores)) if weights is None else weights
    ones, zeros = (labels * weights).sum(), ((1 - labels) * weights).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([scores, np.ones_like(scores)], 1).astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ ((p - target) * weights)
        hess = (x * (p * (1 - p) * weights)[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -1.0, 1.0)
        if np.abs(move).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def best_threshold(scores: np.ndarray, ones: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The middle of the best gap for F1, between 0.1 and 0.9. ``ones`` and ``weights``: texts of label 1, and all texts, of each score."""
    weights = np.ones(len(scores)) if weights is None else weights
    order = np.argsort(scores)
    s, y = scores[order], ones[order]
    right = np.cumsum(y[::-1])[::-1]
    f1 = 2 * right / (np.cumsum(weights[order][::-1])[::-1] + y.sum())
    i = int(f1.argmax())
    low = s[i - 1] if i else 0.0
    return float(np.clip((low + s[i]) / 2, 0.1, 0.9))


def pack(learner: Learner) -> tuple:
    """Plain tuples, which any serializer takes."""
    return tuple(learner.model), learner.state, learner.squares


def unpack(packed: tuple) -> Learner:
    return Learner(ToxicityModel(*packed[0]), packed[1], packed[2])


Rows = tuple[np.ndarray, np.ndarray]
#: ranges of table rows that are summed apart, and the unit of exact sums: their order is not fixed, and the model must not depend on it
BLOCKS, UNIT = 16, 2.0 ** -40


class Change(NamedTuple):
    """What one shard sends on: its small arrays by name, and what changed in both tables and both squares, by row."""
    small: dict[str, np.ndarray]
    rows: list[Rows]


def change(before: Learner, after: Learner) -> Change:
    """Few rows of the tables change in a pass."""
    m = after.model
    small = {f"f{k}": m.filters[k] for k in WIDTHS} | {f"o{k}": m.offsets[k] for k in WIDTHS} | {"out": m.out, "bias": np.float64(m.bias)}
    rows = []
    for x, y in ((before.model.one, m.one), (before.model.two, m.two), *zip(before.squares, after.squares, strict=True)):
        moved = np.flatnonzero((x != y).reshape(len(x), -1).any(1)).astype(np.int32)
        rows.append((moved, y[moved] - x[moved]))
    return Change(small | {f"state {k}": x for k, x in after.state.items()}, rows)


def change_blocks(shard: int, found: Change, size: int) -> Iterator[tuple[int, tuple]]:
    """A change by ranges of rows; the small arrays go with the first."""
    width = -(-size // BLOCKS)
    for b in range(BLOCKS):
        cut = [slice(*np.searchsorted(moved, [b * width, (b + 1) * width])) for moved, _ in found.rows]
        yield b, (shard, found.small if not b else None, [(moved[c], x[c]) for c, (moved, x) in zip(cut, found.rows, strict=True)])


def sum_changes(part: Iterable[tuple[int, tuple]], size: int) -> Iterator[tuple]:
    """``block, [(shard, small arrays)], [(rows, sums)]`` of each block of a partition, one change after the other."""
    width = -(-size // BLOCKS)
    sums: dict[int, tuple[list, list]] = {}
    for b, (shard, small, rows) in part:
        smalls, tables = sums.setdefault(b, ([], [(np.zeros(width, bool), np.zeros((width, *x.shape[1:]), np.int64)) for _, x in rows]))
        if small is not None:
            smalls.append((shard, small))
        for (moved, x), (hit, total) in zip(rows, tables, strict=True):
            hit[moved - b * width] = True
            total[moved - b * width] += np.rint(x.astype(float) / UNIT).astype(np.int64)
    for b, (smalls, tables) in sums.items():
        yield b, smalls, [(np.flatnonzero(hit) + b * width, total[hit]) for hit, total in tables]


def mean_learner(before: Learner, found: list[tuple]) -> Learner:
    """The mean of all shards' learners, from what ``sum_changes`` gives for every block."""
    smalls = [small for _, small in sorted((x for _, smalls, _ in found for x in smalls), key=lambda x: x[0])]
    n = len(smalls)
    tables = [before.model.one.copy(), before.model.two.copy(), *[x.copy() for x in before.squares]]
    for _, _, rows in found:
        for x, (moved, total) in zip(tables, rows, strict=True):
            x[moved] += (total * (UNIT / n)).astype(np.float32)
    mean = {k: np.asarray(sum(np.asarray(x[k], float) for x in smalls) / n, np.float32) for k in smalls[0] if k != "bias"}
    model = before.model._replace(one=tables[0], two=tables[1], filters={k: mean[f"f{k}"] for k in WIDTHS}, offsets={k: mean[f"o{k}"] for k in WIDTHS},
                                  out=mean["out"], bias=float(sum(x["bias"] for x in smalls) / n))
    return Learner(model, {k.removeprefix("state "): x for k, x in mean.items() if k.startswith("state ")}, tables[2:])


def count_blocks(seen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Counts by ranges of rows, in the smallest type that holds them."""
    width = -(-seen.shape[2] // BLOCKS)
    for b in range(BLOCKS):
        own = seen[:, :, b * width:(b + 1) * width]
        yield b, own.astype(np.min_scalar_type(int(own.max(initial=0))))


def sum_counts(part: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    sums: dict[int, np.ndarray] = {}
    for b, own in part:
        sums[b] = sums[b] + own if b in sums else own.astype(np.int64)
    yield from sums.items()


def held_apart() -> Column:
    """The fifth of the labelled ids that calibrates."""
    return F.pmod(F.xxhash64("_hash"), F.lit(5)) == 0


def with_labels(part: Iterable) -> Iterator[tuple]:
    """The texts of a partition with their labels. The row with an id's label comes before its texts; texts of other ids have none."""
    owner = label = None
    for r in part:
        if r["_text"] is None:
            owner, label = r["_id"], r["_label"]
        elif r["_id"] == owner:
            yield r, label


def train_in_shards(rows: DataFrame, shards: int, counts: dict[tuple[bool, int], int]) -> ToxicityModel:
    """Fit on all rows ``_shard, _hash, _id, _label, _lang, _text``, where ``counts`` are those of each fifth and label.

    A row has a text, or the label of all texts of its id: one shuffle brings texts to their labels and deals them to shards.

    Every shard passes once over its texts from the same model, and the mean of the shards' models begins the next round. The counts behind
    the first model are of all texts. What reaches the driver has the size of the model, or of a histogram of scores.
    """
    spark = rows.sparkSession
    ones = sum(n for (_, label), n in counts.items() if label)
    total = sum(counts.values())
    apart = all(counts.get((held, label)) for held in (False, True) for label in (0, 1))  # else all rows learn and calibrate
    # dealt once: later rounds read the same shuffle files
    dealt = rows.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_hash", "_id", F.col("_text").isNotNull(), "_text")
    dealt = dealt.withColumn("_held", held_apart()).rdd

    def by_shard(part):
        for shard, found in groupby(with_labels(part), key=lambda x: x[0]["_shard"]):
            found = list(found)
            yield shard, [r["_text"].encode("utf-8", "replace") for r, _ in found], np.array([x for _, x in found], float), [r for r, _ in found]

    def learns(r) -> bool:
        return not (apart and r["_held"])

    def count(part):
        for _, texts, labels, found in by_shard(part):
            use = [i for i, r in enumerate(found) if learns(r)]
            yield from count_blocks(row_counts([texts[i] for i in use], labels[use], SIZE))

    learned = {label: sum(n for (held, x), n in counts.items() if x == label and not (apart and held)) for label in (0, 1)}
    counted = dict(dealt.mapPartitions(count).partitionBy(BLOCKS).mapPartitions(sum_counts).collect())
    seen = np.concatenate([counted[b] for b in range(BLOCKS)], 2)
    learner = first_learner(first_model(blank_model(ones / total), seen, learned[1] / (learned[0] + learned[1]), np.random.default_rng(SEED), SMOOTHING))
    for turn in range(EPOCHS):
        sent = spark.sparkContext.broadcast(pack(learner))

        def work(part, turn=turn, sent=sent):
            for shard, texts, labels, found in by_shard(part):
                use = np.array([i for i, r in enumerate(found) if learns(r)], np.int64)
                if len(use):
                    own = unpack(sent.value)
                    copy = Learner(own.model._replace(one=own.model.one.copy(), two=own.model.two.copy()), own.state, [x.copy() for x in own.squares])
                    after = epoch(copy, texts, labels, np.random.default_rng([SEED, turn, shard]).permutation(use), RATE, BATCH_DOCS)
                    yield from change_blocks(shard, change(own, after), SIZE)

        changes = dealt.mapPartitions(work).partitionBy(BLOCKS).mapPartitions(lambda part: sum_changes(part, SIZE))
        learner = mean_learner(learner, changes.collect())
        sent.unpersist()
    model = learner.model
    sent = spark.sparkContext.broadcast(tuple(model))

    def histogram(part):
        fitted = ToxicityModel(*sent.value)
        for _, texts, labels, found in by_shard(part):
            seen = Counter()
            for at in range(0, len(texts), BATCH_DOCS):
                own = slice(at, at + BATCH_DOCS)
                cells = np.rint(np.clip(logits(features(texts[own], SIZE), fitted), -60.0, 60.0) * BINS)
                for r, label, cell in zip(found[own], labels[own], cells, strict=True):
                    seen[(not learns(r) or not apart, r["_lang"], int(label), int(cell))] += 1
            yield seen

    scored = dealt.mapPartitions(histogram).treeReduce(lambda a, b: a + b, 3)
    sent.unpersist()
    cells = sorted(scored.items(), key=repr)
    at = lambda chosen: (np.array([k[3] / BINS for k, _ in chosen]), np.array([k[2] for k, _ in chosen], float), np.array([n for _, n in chosen], float))
    scale, shift = platt(*at([c for c in cells if c[0][0]]))
    thresholds = {}
    for lang in sorted({k[1] for k in scored if k[1] is not None}):
        raw, labels, weights = at([c for c in cells if c[0][1] == lang])
        if weights.sum() >= 20 and 3 <= (labels * weights).sum() < weights.sum():
            bins, place = np.unique(raw, return_inverse=True)
            thresholds[lang] = best_threshold(sigmoid(scale * bins + shift), np.bincount(place, labels * weights), np.bincount(place, weights))
    return model._replace(scale=scale, shift=shift, thresholds=thresholds)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
                 label: str = "toxic", shard_documents: int = 4000, shard_chars: int = 30_000_000) -> ToxicityModel:
    """Train on all labelled rows that ``learn`` marks. Rows without id, text or label teach nothing.

    Rows are dealt by the hash of their id to shards of about ``shard_documents`` documents and ``shard_chars`` characters. A table of one
    shard is learned from in one go, more in rounds over all shards.
    """
    marked = labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(key)).agg(F.max(label).cast("int").alias("_label"))
    own_id = F.col(key).cast("string")
    ids = marked.where(own_id.isNotNull()).select(own_id.alias("_id"), F.xxhash64(own_id).alias("_hash"), "_label")
    texts = docs.where(F.col(text).isNotNull()).select(
        F.col(key), own_id.alias("_id"), F.xxhash64(own_id).alias("_hash"), F.col(text).cast("string").alias("_text"), F.length(F.col(text).cast("string")).alias("_chars"), F.col(lang).cast("string").alias("_lang"))
    # texts without a label go before the shuffle, or all documents would be shuffled
    texts = maybe_in(texts, "_id", bits_of(ids, "_id")).where("_maybe")
    found = texts.join(ids, ["_id", "_hash"]).withColumn("_held", held_apart())
    sums = found.groupBy("_held", "_label").agg(F.count(F.lit(1)).alias("n"), F.sum("_chars").alias("chars")).collect()
    n, chars = sum(r["n"] for r in sums), sum(r["chars"] for r in sums)
    shards = max(-(-n // shard_documents), -(-chars // shard_chars))
    if shards <= 1:
        rows = sorted(found.collect(), key=lambda r: (r["_hash"], r[key], r["_text"]))
        return train([r["_text"].encode("utf-8", "replace") for r in rows], np.array([r["_label"] for r in rows], float), [r["_lang"] for r in rows])
    counts = {(r["_held"], r["_label"]): r["n"] for r in sums}
    if len({label for _, label in counts}) < 2:
        return blank_model(float(next(label for _, label in counts)))
    columns = [F.pmod("_hash", F.lit(shards)).cast("int").alias("_shard"), "_hash", "_id", "_label", "_lang", "_text"]
    no_text = {c: F.lit(None).cast("string") for c in ("_lang", "_text")}
    rows = texts.withColumn("_label", F.lit(None).cast("int")).select(*columns).unionByName(ids.withColumns(no_text).select(*columns))
    return train_in_shards(rows, shards, counts)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``toxicity`` (0 to 1), ``toxicity_threshold`` of the row's language (null or unknown: the model's own) and
    ``toxicity_rejected``.

    A null text counts as empty; an empty text is scored as one padding word. Rows are independent: repeated rows get equal
    results, an empty table gives an empty table. The added columns replace columns of the same name; ``keep`` names the others.
    """
    def start():
        def compute(texts: list[bytes]) -> dict[str, np.ndarray]:
            return {"toxicity": sigmoid(model.scale * logits(features(texts, len(model.one)), model) + model.shift).astype(float)}
        return compute

    scored = with_text_columns(docs, text, {"toxicity": DOUBLE}, start, None if keep is None else {*keep, lang})
    cut = F.lit(model.threshold)
    if model.thresholds:
        own = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
        cut = F.coalesce(F.element_at(own, F.coalesce(F.col(lang).cast("string"), F.lit(""))), cut)
    out = scored.withColumn("toxicity_threshold", cut).withColumn("toxicity_rejected", F.col("toxicity") >= F.col("toxicity_threshold"))
    return out if keep is None or lang in keep else out.drop(lang)
