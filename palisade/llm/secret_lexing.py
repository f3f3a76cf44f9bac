"""Secret scans by lexing assignments.

Source and configuration texts are read as ``name = literal`` pairs: quoted or bare values after ``=``, ``:``, ``:=`` or ``=>``,
with or without quotes round the name (JSON, YAML, shell, INI, code). A name on the right side hands its literal on
(``password = DEFAULT_KEY``), over several steps. A literal is scored by the sensitivity of the names it reaches and by its form.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm.batches import LONG, with_text_columns

# fixed values: the base patterns, least lengths and their order
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "literal")

#: part of a target name -> weight
NAME_WEIGHTS = {
    "password": 0.9, "passwd": 0.9, "passphrase": 0.9, "pwd": 0.8, "secret": 0.9, "token": 0.8, "apikey": 0.9, "accesskey": 0.9,
    "privatekey": 0.95, "secretkey": 0.95, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.8, "credentials": 0.8,
    "auth": 0.5, "key": 0.4, "salt": 0.4, "dsn": 0.5, "connectionstring": 0.6, "bearer": 0.7,
}
#: a literal counts from this score on
THRESHOLD = 0.6

_PAIR = re.compile(
    r"""(?<![\w.$-])(?P<q>["']?)(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)(?P=q)[ \t]*(?::=|=>|[:=])(?!=)[ \t]*"""
    r"""(?:"(?P<double>[^"\\\n]*(?:\\.[^"\\\n]*)*)"|'(?P<single>[^'\\\n]*(?:\\.[^'\\\n]*)*)'|(?P<bare>[^\s"',;{}()\[\]]+))""", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*", re.ASCII)
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.ASCII)
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?$", re.ASCII)
_DUMMY = re.compile(r"(?:changeme|example|placeholder|your[_-]?\w*|x+|\*+|none|null|true|false|todo|undefined|test|dummy)$", re.ASCII | re.IGNORECASE)


class Pair(NamedTuple):
    name: str
    value: str
    start: int
    end: int
    quoted: bool


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    name: str
    score: float


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base pattern; those that are too short are dropped afterwards."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 24 is the same match as the whole run tested afterwards, and is found faster
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    return in_order(found)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in the order of the text; start and end enclose the literal without its quotes."""
    if ":" not in text and "=" not in text:
        return []
    found = []
    for m in _PAIR.finditer(text):
        group = "double" if m["double"] is not None else "single" if m["single"] is not None else "bare"
        found.append(Pair(m["name"], m[group], *m.span(group), group != "bare"))
    return found


def name_score(name: str) -> float:
    """The largest weight of a word, or of two words together, in a name like ``db.apiKey`` or ``API_KEY``."""
    words = [w.lower() for w in _HUMP.findall(name)]
    joined = [*words, *(a + b for a, b in zip(words, words[1:], strict=False))]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in joined), default=0.0)


def literal_score(value: str) -> float:
    """0 for references, dummies and short values; else between 0.3 and 1 by characters and entropy."""
    if len(value) < 6 or _DUMMY.match(value) or "${" in value or re.search(r"\s", value):
        return 0.0
    total = len(value)
    entropy = -sum(n / total * math.log2(n / total) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
    return min(1.0, 0.3 + 0.1 * kinds + 0.1 * min(entropy, 4.0))


def literal_findings(text: str) -> list[Finding]:
    """Literals whose own name, or a name they are handed on to, is sensitive enough."""
    found = pairs(text)
    if not found:
        return []
    literal: dict[str, Pair] = {}
    reached: dict[Pair, tuple[float, str]] = {}
    for p in found:
        reference = _REFERENCE.match(p.value)
        named = reference[1] if reference else p.value if not p.quoted and _NAME.fullmatch(p.value) else None
        source = literal.get(named, None) if named is not None else p
        if source is None:
            # a bare word that names nothing known is itself the literal, except a reference to the environment
            if reference:
                literal.pop(p.name, None)
                continue
            source = p
        literal[p.name] = source
        score = name_score(p.name)
        if score > reached.get(source, (0.0, ""))[0]:
            reached[source] = (score, p.name)
    out = []
    for p, (score, name) in reached.items():
        form = literal_score(p.value)
        total = 0.0 if not form else score * (0.5 + 0.5 * form)
        if total >= THRESHOLD:
            out.append(Finding("literal", p.start, p.end, name, round(total, 6)))
    return out


def secret_spans(text: str) -> list[Finding]:
    """All spans of a text by start, then kind."""
    found = [Finding(*s, "", 1.0) for s in base_spans(text)] + literal_findings(text)
    return sorted(found, key=lambda f: (f.start, KINDS.index(f.kind), f.end))


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])


def secret_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``secret_spans`` (kind, start, end, name, score; code points, end exclusive) and ``secret_count``.

    A null text counts as empty and has none. Rows are independent: repeated rows get equal results, an empty table gives an
    empty table. The added columns replace columns of the same name; ``keep`` names the others that stay.
    """
    def start():
        def compute(texts: list[bytes]) -> dict[str, list]:
            found = [secret_spans(t.decode("utf-8")) for t in texts]
            return {"secret_spans": [[f._asdict() for f in x] for x in found], "secret_count": [len(x) for x in found]}
        return compute

    added = {"secret_spans": ("array<struct<kind:string,start:long,end:long,name:string,score:double>>", pa.list_(_FINDING)), "secret_count": LONG}
    return with_text_columns(docs, text, added, start, keep)
