"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads each text once. At every character its output links name the pieces that end
there, from the longest to the shortest, and each relaxes the best score of that place (Viterbi). Pieces begin with the space
mark or hold none, so a text falls into independent segments; equal segments of a batch are encoded once, and the automaton
advances over all of them in step as numpy arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm.batches import LONG, with_text_columns
from palisade.llm.tables import small_batches

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: an unknown character costs this much more than the worst piece
UNKNOWN_PENALTY = 10.0
#: characters whose symbols are looked up at once, so that this needs little beside the arrays of whole texts
SYMBOL_RUN = 1 << 16


class Vocabulary(NamedTuple):
    """Pieces by id, with what the automaton needs. States are numbered by breadth; state 0 is the root."""
    spelled: list[bytes]
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    symbols: np.ndarray
    edges: np.ndarray
    target: np.ndarray
    fail: np.ndarray
    link: np.ndarray
    depth: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    separable: bool


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a model file in the driver; tasks get the tables."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, byte_ids, spelled = [], np.full(256, -1, np.int64), []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            spelled.append(bytes([int(text[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"" if not model.is_unknown(i) else " ⁇ ".encode())
        else:
            pieces.append((text, i, model.get_score(i)))
            spelled.append(text.replace(SPACE, " ").encode())
    return build(pieces, spelled, byte_ids, model.unk_id())


def build(pieces: list[tuple[str, int, float]], spelled: list[bytes], byte_ids: np.ndarray, unknown: int) -> Vocabulary:
    children: list[dict[str, int]] = [{}]
    piece, score, depth = [-1], [0.0], [0]
    for text, i, s in pieces:
        at = 0
        for c in text:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                piece.append(-1)
                score.append(0.0)
                depth.append(depth[at] + 1)
            at = children[at][c]
        piece[at], score[at] = i, s
    fail, link = [0] * len(children), [0] * len(children)
    queue = [(0, c, s) for c, s in children[0].items()]
    for parent, c, s in queue:
        f = fail[parent]
        while parent and f and c not in children[f]:
            f = fail[f]
        fail[s] = children[f].get(c, 0) if parent else 0
        link[s] = fail[s] if piece[fail[s]] >= 0 else link[fail[s]]
        queue.extend((s, d, t) for d, t in children[s].items())
    symbols = np.array(sorted({ord(c) for text, _, _ in pieces for c in text}), np.int64)
    number = {int(c): k + 1 for k, c in enumerate(symbols)}
    keys = np.array([(s * (len(symbols) + 1)) + number[ord(c)] for s, kids in enumerate(children) for c in kids], np.int64)
    goal = np.array([t for kids in children for t in kids.values()], np.int64)
    order = np.argsort(keys)
    worst = min((s for _, _, s in pieces), default=0.0)
    separable = not any(SPACE in text.lstrip(SPACE) for text, _, _ in pieces)
    return Vocabulary(spelled, byte_ids, unknown, worst - UNKNOWN_PENALTY, symbols, keys[order], goal[order], np.array(fail, np.int64),
                      np.array(link, np.int64), np.array(depth, np.int64), np.array(piece, np.int64), np.array(score), separable)


def segments(text: str, vocabulary: Vocabulary) -> list[str]:
    """The escaped text with its leading space mark, cut before every run of space marks."""
    if not text:
        return []
    escaped = SPACE + text.replace(" ", SPACE)
    return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", escaped) if vocabulary.separable else [escaped]


def advance(v: Vocabulary, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """One step of the automaton for many texts: goto edges, else failure links up to the root."""
    width = len(v.symbols) + 1
    todo = np.arange(len(state))
    state = state.copy()
    while len(todo):
        key = state[todo] * width + symbol[todo]
        place = np.minimum(np.searchsorted(v.edges, key), max(len(v.edges) - 1, 0))
        hit = (v.edges[place] == key) & (symbol[todo] > 0) if len(v.edges) else np.zeros(len(todo), bool)
        state[todo[hit]] = v.target[place[hit]]
        missed = todo[~hit]
        over = (state[missed] == 0) | (symbol[missed] == 0)
        state[missed[over]] = 0
        todo = missed[~over]
        state[todo] = v.fail[state[todo]]
    return state


def encode_segments(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all segments one after the other, and where each begins (with one more entry)."""
    if not texts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-length, kind="stable")
    length = length[order]
    points = np.frombuffer("".join(map(texts.__getitem__, order.tolist())).encode("utf-32-le"), np.int32)
    symbols = v.symbols.astype(np.int32)
    symbol = np.zeros(len(points), np.int32)
    for a in range(0, len(points) if len(symbols) else 0, SYMBOL_RUN):
        run = points[a:a + SYMBOL_RUN]
        place = np.minimum(np.searchsorted(symbols, run), len(symbols) - 1)
        symbol[a:a + SYMBOL_RUN] = np.where(symbols[place] == run, place + 1, 0)
    begin = np.cumsum(length) - length
    row = begin + np.arange(len(length))  # one more place per segment
    best = np.full(len(points) + len(length), -np.inf)
    best[row] = 0.0
    back = np.zeros(len(best), np.int32)
    chosen = np.full(len(best), -1, np.int32)
    state = np.zeros(len(length), np.int64)
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # segments longer than t
    for t in range(int(length[0])):
        m = int(live[t])
        state = advance(v, state[:m], symbol[begin[:m] + t])
        end = row[:m] + t + 1
        single = np.zeros(m, bool)
        node = np.where(v.piece[state] >= 0, state, v.link[state])
        todo = np.flatnonzero(node)
        while len(todo):
            n = node[todo]
            d = v.depth[n]
            value = best[end[todo] - d] + v.score[n]
            better = value > best[end[todo]]
            k = todo[better]
            best[end[k]], back[end[k]], chosen[end[k]] = value[better], d[better], v.piece[n[better]]
            single[todo[d == 1]] = True
            node[todo] = v.link[n]
            todo = todo[node[todo] > 0]
        k = np.flatnonzero(~single)
        value = best[end[k] - 1] + v.unknown_score
        k = k[value > best[end[k]]]
        best[end[k]], back[end[k]], chosen[end[k]] = best[end[k] - 1] + v.unknown_score, 1, -1
    # walk back from all ends together
    at = length.copy()
    who, where, what = [], [], []
    open_ = np.flatnonzero(at > 0)
    while len(open_):
        cell = row[open_] + at[open_]
        who.append(open_.astype(np.int32))
        where.append(at[open_].astype(np.int32))
        what.append(chosen[cell])
        at[open_] -= back[cell]
        open_ = open_[at[open_] > 0]
    who, where, what = np.concatenate(who), np.concatenate(where), np.concatenate(what)
    who, original = order.astype(np.int32)[who], who
    step = np.lexsort((where, who))
    who, where, what, original = who[step], where[step], what[step], original[step]
    lost = np.flatnonzero(what < 0)
    if len(lost):
        if (v.byte_ids >= 0).all():
            parts = [v.byte_ids[list(chr(points[begin[original[i]] + where[i] - 1]).encode("utf-8", "replace"))] for i in lost]
        else:
            parts = [np.array([v.unknown])] * len(lost)
        size = np.ones(len(what), np.int64)
        size[lost] = [len(p) for p in parts]
        spread = np.repeat(what, size)
        into = np.cumsum(size) - size
        for i, p in zip(lost, parts, strict=True):
            spread[into[i]:into[i] + len(p)] = p
        who, what = np.repeat(who, size), spread
    return what.astype(np.int32), np.searchsorted(who, np.arange(len(texts) + 1))


def encode(texts: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and where each text begins (with one more entry)."""
    known: dict[str, int] = {}
    index, count = [], []
    for text in texts:
        parts = segments(text, v)
        index.extend([known.setdefault(p, len(known)) for p in parts])
        count.append(len(parts))
    ids, first = encode_segments(list(known), v)
    index = np.array(index, np.int64)
    size = np.diff(first)[index]
    into = np.cumsum(size) - size
    flat = ids[np.repeat(first[index] - into, size) + np.arange(int(size.sum()))] if len(index) else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat, ends[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of piece ids: byte pieces become bytes, space marks spaces, and the leading space goes. Unknown ids raise."""
    data = b"".join(map(v.spelled.__getitem__, ids))
    return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


def id_lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column as Python lists, without an Arrow object per id."""
    flat, first, valid = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist(), column.is_valid().to_pylist()
    return (flat[a:b].tolist() if ok else None for a, b, ok in zip(first[:-1], first[1:], valid, strict=True))


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``piece_ids`` and ``n_pieces``. A null or empty text has no pieces.

    Rows are independent: repeated rows get equal results, an empty table gives an empty table. Ties go to the longer last
    piece. The added columns replace columns of the same name; ``keep`` names the others that stay.
    """
    def start():
        def compute(texts: list[bytes]) -> dict[str, object]:
            flat, first = encode([t.decode("utf-8") for t in texts], vocabulary)
            return {"piece_ids": [flat[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], "n_pieces": np.diff(first)}
        return compute

    added = {"piece_ids": ("array<int>", pa.list_(pa.int32())), "n_pieces": LONG}
    # the arrays take up to eighty bytes a character
    return with_text_columns(docs, text, added, start, keep, limit=500_000)


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Rows with the text of ``ids`` in ``out``, which replaces a column of that name; null ids give null.

    Decoding an encoding gives the text back, except that a space mark (U+2581) in the text comes back as a space.
    """
    small_batches(encoded.sparkSession)
    kept = encoded.drop(out)
    names = [*kept.columns, out]
    place = kept.columns.index(ids)
    sent = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])

    def work(batches):
        for batch in batches:
            texts = [decode(x, vocabulary) if x is not None else None for x in id_lists(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return sent.mapInArrow(work, kept.schema.add(out, "string"))
