"""Exact token counts of every prefix of a text, for byte-fallback BPE piece models.

A dynamic program walks each text once. The encoding of a prefix ends in one piece, and the encoding of what stands before that
piece is the rest: so the last piece of a prefix is the only piece ending there that stays whole beside the last piece of the
shorter prefix, and ``count[i] = count[i - length] + 1``. Two pieces stay whole side by side unless, as their last merges are undone
one by one from the latest, some union across the border has a merge of its own that comes earlier; this is found once per pair.
No prefix is ever encoded on its own, so any truncation or budget is answered from the counts.

Pieces hold the space mark only at their beginning, and characters that no piece holds are bytes of their own; a text is cut at both,
and equal segments are walked once per worker.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.batches import LONG, with_text_columns

SPACE = "▁"
COUNTS = ("array<int>", pa.list_(pa.int32()))
#: a step is a count above this many bits and the number of the last piece in them
SHIFT = 20
LAST = (1 << SHIFT) - 1
#: counts of segments of up to this many characters are remembered: the last so many, and as many before them
REMEMBERED_CHARS, REMEMBERED = 48, 1_000_000


class PieceModel(NamedTuple):
    """``digest`` names the file. ``scores``: merge priority of each piece. ``halves``: what each piece of several characters that BPE can form is merged from at
    last. ``prefixed``: texts get a leading space mark. ``separable``: see the module."""
    digest: str
    scores: dict[str, float]
    halves: dict[str, tuple[str, str]]
    prefixed: bool
    separable: bool


def load_model(path: str) -> PieceModel:
    """Read a model file in the driver. Only models whose text rules are a space mark for every space, and an optional leading one, are
    accepted: others raise."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    content = Path(path).read_bytes()
    proto.ParseFromString(content)
    rules, spec = proto.normalizer_spec, proto.trainer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or spec.treat_whitespace_as_suffix or not spec.byte_fallback or spec.model_type != spec.BPE:
        raise ValueError("not a byte-fallback BPE model without normalisation")
    model = SentencePieceProcessor(model_file=path)
    special = {"control": model.is_control, "unknown": model.is_unknown, "byte": model.is_byte}
    plain = [i for i in range(model.get_piece_size()) if not any(test(i) for test in special.values())]
    kinds = {p.type for p in proto.pieces}
    if kinds & {proto.SentencePiece.USER_DEFINED, proto.SentencePiece.UNUSED}:
        raise ValueError("user-defined or unused pieces")
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    halves = {}
    for piece in scores:
        sizes = merged(piece, scores, leave=2) if len(piece) > 1 else []
        if len(sizes) == 2 and merged(piece, scores) == [len(piece)]:
            halves[piece] = (piece[:sizes[0]], piece[sizes[0]:])
    return PieceModel(hashlib.sha256(content).hexdigest(), scores, halves, rules.add_dummy_prefix, not any(SPACE in p.lstrip(SPACE) for p in scores))


def merged(text: str, scores: dict[str, float], leave: int = 1) -> list[int]:
    """Lengths of the parts that BPE makes of a short text by definition: the neighbours whose union has the best score merge first, the
    leftmost of equals, until ``leave`` parts are left or none merge."""
    parts = list(text)
    while len(parts) > leave:
        best, place = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, place = score, i
        if place < 0:
            break
        parts[place:place + 2] = [parts[place] + parts[place + 1]]
    return list(map(len, parts))


class PrefixCounter:
    """Counts of all prefixes of texts. One per worker; what it remembers is bounded."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.letters = {c for p in model.scores for c in p}
        #: when a piece of several characters is merged: the best score first
        self.turn = {p: -s for p, s in model.scores.items() if len(p) > 1}
        self.spelled = ["", *sorted(self.letters | model.halves.keys())]
        self.cost = [(1 if piece in model.scores else len(piece.encode())) << SHIFT for piece in self.spelled]
        self.length = list(map(len, self.spelled))
        self.longest = max(self.length)
        self.pieces = ahocorasick.Automaton()
        for i, piece in enumerate(self.spelled[1:], 1):
            self.pieces.add_word(piece, i)
        self.pieces.make_automaton()
        # whole numbers only: the garbage collector need not look at them
        self.whole: dict[int, bool] = {}
        #: counts of segments, those of the last batches and the ones before; of long ones only the last batch's
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.long: list[str] = []
        self.cut = re.compile(self._segment() if model.separable else r"(?s:.+)")

    def _segment(self) -> str:
        """Space marks and what follows them: characters that pieces join, directly or through others, or one of the rest."""
        group = {c: {c} for c in self.letters}
        for piece in self.model.halves:
            for a, b in itertools.pairwise(piece.lstrip(SPACE)):
                if group[a] is not group[b]:
                    small, large = sorted((group[a], group[b]), key=len)
                    large |= small
                    group.update(dict.fromkeys(small, large))
        group.pop(SPACE, None)
        runs = {id(g): f"[{re.escape(''.join(sorted(g)))}]+" for g in group.values() if len(g) > 1}
        alone = re.escape("".join(sorted(c for c, g in group.items() if len(g) == 1)))
        follow = [*sorted(runs.values(), key=len, reverse=True), *([f"[{alone}]"] if alone else [])]
        return f"{SPACE}*(?:{'|'.join(follow)})|{SPACE}+|[^{SPACE}]" if follow else f"{SPACE}+|[^{SPACE}]"

    def segments(self, text: str) -> list[str]:
        escaped = text.replace(" ", SPACE)
        return self.cut.findall(SPACE + escaped if self.model.prefixed and text else escaped)

    def _side_by_side(self, left: str, right: str) -> bool:
        """Whether no merge joins the two pieces."""
        turn, halves = self.turn, self.model.halves
        if not left.strip(SPACE):  # runs of space marks share one score, so that the leftmost merges first: ask the definition
            at = 0
            for size in merged(left + right, self.model.scores):
                at += size
                if at >= len(left):
                    return at == len(left)
        limit = math.inf
        while True:
            across = turn.get(left + right)
            if across is not None and across < limit:
                return False
            at_left, at_right = turn.get(left, -1.0), turn.get(right, -1.0)
            if at_left > at_right:
                limit, left = at_left, halves[left][1]
            elif at_right >= 0:
                limit, right = at_right + 0.5, halves[right][0]
            else:
                return True

    def _extend(self, text: str, steps: list[int]) -> None:
        """``steps`` holds a step for each of the shortest prefixes of ``text``, the empty one first; those of the others are added. A step
        is the count and the number of the last piece (0: bytes, or none) as one whole number. An automaton names the pieces that end at each
        character, the longest first."""
        whole, cost, length = self.whole, self.cost, self.length
        done = len(steps)
        for end, piece in self.pieces.iter(text, max(0, done - self.longest)):
            end += 1
            if end < done:
                continue
            while done < end:  # characters that no piece holds
                self._bytes(text, steps)
                done += 1
            step = steps[end - length[piece]]
            before = step & LAST
            if before:
                pair = before << SHIFT | piece
                stay = whole.get(pair)
                if stay is None:
                    if len(whole) >= REMEMBERED:
                        whole.clear()
                    stay = whole[pair] = self._side_by_side(self.spelled[before], self.spelled[piece])
                if not stay:
                    continue
            steps.append((step - before) + cost[piece] + piece)
            done += 1
        while done <= len(text):
            self._bytes(text, steps)
            done += 1

    @staticmethod
    def _bytes(text: str, steps: list[int]) -> None:
        """The next character is its bytes, and nothing merges across them."""
        steps.append((steps[-1] & ~LAST) + (len(text[len(steps) - 1].encode("utf-8", "replace")) << SHIFT))

    def _learn(self, lists: list[list[str]]) -> None:
        """Make the counts of all segments known. In sorted order a segment goes on from what it shares with the one before it."""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        for segment in self.long:
            self.known.pop(segment, None)
        known, older = self.known, self.older
        new = set(itertools.chain.from_iterable(lists)).difference(known)
        known.update({segment: older[segment] for segment in new if segment in older})
        steps, before = [0], ""
        for segment in sorted(new.difference(older)):
            same = len(before)
            while not segment.startswith(before[:same]):
                same -= 1
            del steps[same + 1:]
            self._extend(segment, steps)
            known[segment] = steps[-1] >> SHIFT
            before = segment
        self.long = [segment for segment in new if len(segment) > REMEMBERED_CHARS]

    def prefixes(self, segment: str) -> list[int]:
        """Counts of the first 1, 2, ... characters of a segment."""
        steps = [0]
        self._extend(segment, steps)
        return [step >> SHIFT for step in steps[1:]]

    def totals(self, texts: list[str]) -> list[int]:
        """Counts of whole texts."""
        lists = [self.segments(t) for t in texts]
        self._learn(lists)
        return [sum(map(self.known.__getitem__, segments)) for segments in lists]

    def all_prefixes(self, text: str) -> np.ndarray:
        """Counts of the first 0, 1, ... code points of a text."""
        parts = [np.asarray(self.prefixes(s), np.int32) for s in self.segments(text)]
        out = np.zeros(len(text) + 1, np.int32)
        if parts:
            base = np.cumsum([0, *(p[-1] for p in parts[:-1])])
            counts = np.concatenate([p + b for p, b in zip(parts, base, strict=True)])
            out[1:] = counts[1:] if self.model.prefixed else counts
        return out

    def longest_within(self, text: str, budget: int, total: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens (a count can fall as a prefix grows)."""
        if total <= budget:
            return len(text)
        at, base, best = -1 if self.model.prefixed else 0, 0, 0
        for s in self.segments(text):
            if base >= budget:
                break
            counts = self.prefixes(s)
            fits = [k for k, c in enumerate(counts, 1) if base + c <= budget]
            best = max(best, at + fits[-1]) if fits else best
            at, base = at + len(s), base + counts[-1]
        return best


_counters: dict[str, PrefixCounter] = {}


def _counter(model: PieceModel) -> PrefixCounter:
    """A worker that runs several tasks keeps its counter."""
    if model.digest not in _counters:
        _counters.clear()
        _counters[model.digest] = PrefixCounter(model)
    return _counters[model.digest]


def count_tokens(docs: DataFrame, model: PieceModel, budget: int, text: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens``, and ``budget_chars``: code points of the longest prefix of at most ``budget`` tokens.

    Null texts count as empty: 0 bytes, 0 tokens. Rows stay as they are, repeated ones too; a column of an added name is replaced; an empty
    table gives an empty one. Texts of any length are walked whole.
    """
    def start():
        counter = _counter(model)

        def work(texts: list[bytes]) -> dict[str, list[int]]:
            whole = [t.decode("utf-8", "replace") for t in texts]
            totals = counter.totals(whole)
            return {"n_bytes": [len(t) for t in texts], "n_tokens": totals,
                    "budget_chars": [counter.longest_within(t, budget, n) for t, n in zip(whole, totals, strict=True)]}
        return work

    return with_text_columns(docs, text, {"n_bytes": LONG, "n_tokens": LONG, "budget_chars": LONG}, start, keep, rows=2000, limit=4_000_000)


def prefix_counts(docs: DataFrame, model: PieceModel, text: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """Add ``prefix_tokens``: the token counts of the first 0, 1, ... code points, to be stored beside the text. Null texts count as empty."""
    def start():
        counter = _counter(model)
        return lambda texts: {"prefix_tokens": [counter.all_prefixes(t.decode("utf-8", "replace")) for t in texts]}

    return with_text_columns(docs, text, {"prefix_tokens": COUNTS}, start, keep)


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points (all if there are fewer), from stored counts."""
    return F.element_at(counts, (F.least(F.greatest(chars, F.lit(0)), F.size(counts) - 1) + 1).cast("int"))


def chars_within(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from stored counts; null for a budget below 0."""
    return F.array_max(F.filter(F.transform(counts, lambda c, i: F.when(c <= budget, i)), lambda i: i.isNotNull()))
