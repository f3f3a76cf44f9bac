"""Turn rule tables into expressions.

Every pattern stays a literal, so Spark compiles it once per task, and every pattern is preceded by a
plain substring test.  The matching runs inside array functions over the lines of one row: a file
without an anchor costs no split and no row, and a hit never needs a shuffle to find its first line.

Large rule tables are written as one SQL expression each: it is the same expression tree as with
``Column`` calls, but handed to Spark in a single call instead of several thousand.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import LINE_BREAK, each
from palisade.rules.model import Rule

#: characters of a text that are looked at together
CHUNK = 1 << 20
#: anchors are found by so many letters or digits, in a table of so many slots
GRAM, SLOTS = 4, 1 << 14
#: letters from the most usual in texts to the least
COMMON = "etaoinsrhdlucmfywgpbvkxqjz"


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _may_match(rule: Rule, text: str, lowered: str) -> str:
    """Cheap necessary condition for a match."""
    if rule.anchors:
        return "(" + " OR ".join(f"contains({lowered if rule.ignores_case else text}, {quote(a)})"
                                 for a in rule.anchors) + ")"
    return f"({text} RLIKE {quote(rule.gate)})" if rule.gate else "true"


def _matches(rule: Rule, text: str, lowered: str) -> str:
    test = f"{text} RLIKE {quote(rule.regex)}"
    return f"{_may_match(rule, text, lowered)} AND {test}" if rule.anchors else test


def first_match_sql(rules: Sequence[Rule], text: str) -> str:
    return "CASE " + " ".join(f"WHEN {_matches(r, text, f'lower({text})')} THEN {i}"
                              for i, r in enumerate(rules, 1)) + " END"


def first_match(rules: Sequence[Rule], text: str) -> Column:
    """1-based position of the first rule that matches the named column, or null."""
    return F.expr(first_match_sql(rules, text))


def all_matches(rules: Sequence[Rule], text: str) -> Column:
    """Array of the 1-based positions of all rules that match the named column."""
    tests = ", ".join(f"CASE WHEN {_matches(r, text, f'lower({text})')} THEN {i} END" for i, r in enumerate(rules, 1))
    return F.expr(f"filter(array({tests}), n -> n IS NOT NULL)")


def first_match_lines(rules: Sequence[Rule], lines: str) -> Column:
    """``array<struct<line, n, text>>`` of the lines any rule matches, ``n`` being the first such rule."""
    return F.expr(f"filter(transform({lines}, l -> named_struct('line', l.line, 'n', "
                  f"{first_match_sql(rules, 'l.text')}, 'text', l.text)), h -> h.n IS NOT NULL)")


def any_may_match(rules: Sequence[Rule], text: str) -> Column:
    """False only if no rule of the table can match anywhere in the named column.

    The text and its lower case are bound once, as a lambda body the many tests also stay out of generated
    code, where they would exceed the size that is compiled to machine code.
    """
    if any(not r.anchors and not r.gate for r in rules):
        return F.lit(True)
    # short literals first: they are the likeliest to end the search in files that do need a scan
    tests = sorted({_may_match(r, "t.raw", "t.low") for r in rules}, key=lambda t: (len(t), t))
    return F.expr(f"exists(array(named_struct('raw', {text}, 'low', lower({text}))), t -> {' OR '.join(tests)})")


def distinct_matches(rules: Sequence[Rule], text: str) -> Column:
    """``array<struct<rule_order, match>>``: the distinct whole matches of every rule."""
    per_rule = ", ".join(
        f"CASE WHEN {_may_match(r, text, f'lower({text})')} THEN transform(array_distinct("
        f"regexp_extract_all({text}, {quote(r.regex)}, 0)), "
        f"m -> named_struct('rule_order', {i}, 'match', m)) END" for i, r in enumerate(rules, 1))
    return F.expr(f"flatten(filter(array({per_rule}), a -> a IS NOT NULL))")


def mask_matches(rules: Sequence[Rule], text: str) -> Column:
    """The text with the matches of every rule replaced, one rule after the other.

    A character that a pattern reads before the secret stays.
    """
    masked = text
    for r in rules:
        before = r.regex.startswith("(?:^|")
        masked = f"regexp_replace({masked}, {quote('(' + r.regex[3:] if before else r.regex)}, '{'$1' if before else ''}***')"
    return F.expr(masked)


def rule_fields(rules: Sequence[Rule], order: str, names=("rule_id", "severity", "description")) -> list[Column]:
    """Columns of the rule at the 1-based position in the named column."""
    def pick(name: str) -> Column:
        values = ", ".join("CAST(NULL AS STRING)" if getattr(r, name) is None else quote(getattr(r, name)) for r in rules)
        return F.expr(f"get(array({values}), {order} - 1)").alias(name)
    return [pick(n) for n in names]


def _gram(anchor: str) -> str | None:
    """The ``GRAM`` letters or digits of an anchor, in lower case, that are the least usual in texts; null if it has too few."""
    runs = re.findall("[a-z0-9]+", anchor.lower())
    grams = [run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)]
    return max(grams, key=lambda g: (sum(COMMON.index(c) if c in COMMON else len(COMMON) for c in g), g), default=None)


def _constant(values: list, kind: str) -> str:
    """SQL of an array that is folded to one constant, however long."""
    return f"from_json({quote(json.dumps(values))}, {quote(f'array<{kind}>')})"


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SLOTS


def _candidates(rules: Sequence[tuple[int, Rule]]) -> str:
    """SQL: the numbers of the rules that text ``c`` (``low`` in lower case) may match, by an index from the grams of anchors to rules.

    The text's different words are taken once and their grams looked up; anchors with a gram in the text, and those too short to have one,
    are then searched."""
    anchors = [(i, r.ignores_case, a) for i, r in rules for a in r.anchors]
    table: list[list[int]] = [[] for _ in range(SLOTS)]
    always = []
    for n, (_, _, a) in enumerate(anchors):
        gram = _gram(a)
        (table[_slot(gram)] if gram else always).append(n)
    grams = sorted({g for _, _, a in anchors if (g := _gram(a))})
    words = "array_join(array_distinct(split(low, '[^a-z0-9]+')), ' ')"
    held = f"array_intersect(regexp_extract_all({words}, '(?=([a-z0-9]{{{GRAM}}}))', 1), {_constant(grams, 'string')})"
    looked_up = f"flatten(transform({held}, g -> get({_constant(table, 'array<int>')}, CAST(crc32(g) % {SLOTS} AS INT))))"
    folded, spelled = _constant([f for _, f, _ in anchors], "boolean"), _constant([a for _, _, a in anchors], "string")
    found = f"filter(concat({looked_up}, {_constant(always, 'int')}), n -> contains(CASE WHEN get({folded}, n) THEN low ELSE c END, get({spelled}, n)))"
    numbers = f"transform({found}, n -> get({_constant([i for i, _, _ in anchors], 'int')}, n))"
    return f"array_sort(array_distinct(concat({numbers}, {_constant([i for i, r in rules if not r.anchors], 'int')})))"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lines_of(text: str) -> str:
    """``numbered_lines`` as SQL."""
    kept = "CASE WHEN element_at(p, -1) = '' THEN slice(p, 1, size(p) - 1) ELSE p END"
    return _let(f"split({text}, {quote(LINE_BREAK)})", "p", f"transform({kept}, (x, i) -> named_struct('line', i + 1, 'text', x))")


def _hit_lines(rules: Sequence[tuple[int, Rule]], first_only: bool) -> str:
    """SQL: the lines of ``ls`` that rule ``n`` matches. Its expression is tried where one of its literals stands, and no longer than needed."""
    last = max(i for i, _ in rules) + 1
    by_number = dict(rules)
    of = lambda value, none: [value(by_number[i]) if i in by_number else none for i in range(last)]
    regex = f"get({_constant(of(lambda r: r.regex, ''), 'string')}, n)"
    anchors = f"get({_constant(of(lambda r: list(r.anchors) or [''], []), 'array<string>')}, n)"
    folds = f"get({_constant(of(lambda r: r.ignores_case, False), 'boolean')}, n)"
    spelled = f"CASE WHEN {folds} THEN lower(l.text) ELSE l.text END"
    test = f"exists({anchors}, a -> contains({spelled}, a)) AND l.text RLIKE {regex}"
    if not first_only:
        return f"filter(ls, l -> {test})"
    return f"filter(array(aggregate(ls, CAST(NULL AS STRUCT<line: INT, text: STRING>), (f, l) -> CASE WHEN f IS NOT NULL THEN f WHEN {test} THEN l END)), f -> f IS NOT NULL)"


def hits_column(rules: Sequence[Rule], applies: Callable[[Rule], str] | None = None, first_only: bool = True, chunk: int = CHUNK) -> Column:
    """``array<struct<rule_order, hits: array<struct<line, text>>>>`` of the column ``content``.

    ``applies`` names, as SQL, the files a rule reads. The rules that a text may match are looked up by the grams of its words, so a rule
    without a word in a text costs that text nothing, and a text without any is not split. A text of more than ``chunk`` characters is looked
    at in chunks of whole lines, one after the other in its row; rules over whole files still see it whole.
    """
    numbered = list(enumerate(rules, 1))
    line_rules = [(i, r) for i, r in numbered if r.scope != "file"]

    def read(r: Rule, test: str) -> str:
        return f"{applies(r)} AND {test}" if applies is not None else test

    # a rule that reads only some files is left out in the others
    restricted = [(i, applies(r)) for i, r in line_rules] if applies is not None else []
    tests = sorted({t for _, t in restricted})
    unread = [f"CASE WHEN NOT coalesce({t}, false) THEN {_constant([i for i, own in restricted if own == t], 'int')} ELSE CAST(array() AS ARRAY<INT>) END" for t in tests]
    candidates = _candidates(line_rules) if line_rules else ""
    candidates = f"array_except({candidates}, concat({', '.join(unread)}))" if unread else candidates
    none = "CAST(array() AS ARRAY<STRUCT<rule_order: INT, hits: ARRAY<STRUCT<line: INT, text: STRING>>>>)"
    if line_rules:
        of_lines = _let(_lines_of("c"), "ls", f"filter(transform(chosen, n -> named_struct('rule_order', n, 'hits', {_hit_lines(line_rules, first_only)})), s -> size(s.hits) > 0)")
        of_chunk = f"CASE WHEN size(chosen) > 0 THEN {of_lines} ELSE {none} END"
        of_chunk = _let("lower(c)", "low", _let(candidates, "chosen", of_chunk))
        pattern = quote(rf"(?s).{{1,{chunk}}}[^\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]*(?:{LINE_BREAK}|\z)")
        before = f"aggregate(slice(cs, 1, k), 0, (n, x) -> n + size(split(x, {quote(LINE_BREAK)})) - 1)"
        moved = f"transform({of_chunk}, s -> named_struct('rule_order', s.rule_order, 'hits', transform(s.hits, l -> named_struct('line', l.line + before, 'text', l.text))))"
        chunks = f"flatten(transform(cs, (c, k) -> CASE WHEN k = 0 THEN {of_chunk} ELSE {_let(before, 'before', moved)} END))"
        chunks = f"CASE WHEN length(content) <= {chunk} THEN {_let('content', 'c', of_chunk)} ELSE {_let(f'regexp_extract_all(content, {pattern}, 0)', 'cs', chunks)} END"
    else:
        chunks = none
    whole = []
    for i, r in numbered:
        if r.scope == "file":
            before = f"element_at(split(content, {quote(r.regex)}, 2), 1)"
            at = f"element_at({_lines_of('content')}, size(split({before}, {quote(LINE_BREAK)})))"
            gate = read(r, f"{_may_match(r, 'content', 'lower(content)')} AND content RLIKE {quote(r.regex)}")
            whole.append(f"CASE WHEN {gate} THEN named_struct('rule_order', {i}, 'hits', array({at})) END")
    hits = f"concat({chunks}, filter(array({', '.join(whole)}), s -> size(s.hits) > 0))" if whole else chunks
    if first_only:  # of several chunks the first that has a hit of the rule
        hits = _let(hits, "hs", "filter(hs, (s, i) -> NOT exists(slice(hs, 1, i), e -> e.rule_order = s.rule_order))")
    return F.expr(hits)


def file_hits(files: DataFrame, rules: Sequence[Rule], applies: Callable[[Rule], str] | None = None,
              first_only: bool = True, chunk: int = CHUNK, column: str | None = None) -> DataFrame:
    """Hits of every rule in every file: one row per hit, or per (file, rule) when ``first_only``.

    ``files`` needs ``content``, or in ``column`` what ``hits_column`` gives; its other columns are kept.
    """
    kept = [c for c in files.columns if c not in ("content", column)]
    return (
        each(files, F.col(column) if column else hits_column(rules, applies, first_only, chunk), "_rule", *kept)
        .select(*kept, F.col("_rule.rule_order").alias("rule_order"), F.explode("_rule.hits").alias("_hit"))
        .select(*kept, "rule_order", *rule_fields(rules, "rule_order"),
                F.col("_hit.line").alias("line"), F.col("_hit.text").alias("text"))
    )
