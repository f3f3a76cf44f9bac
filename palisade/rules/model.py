"""Shape of a rule row.

A rule is plain data.  The regular expression is kept as a literal so that Spark compiles it once
per task; a guarded rule keeps its look-ahead in separate parts, because the parts are also what an
engine without look-around needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Unless:
    """``head`` not followed by any of ``guards``, then ``tail``."""

    head: str
    guards: tuple[str, ...]
    tail: str = ""

    @property
    def regex(self) -> str:
        return self.head + "".join(f"(?!{g})" for g in self.guards) + self.tail


def unless(head: str, *guards: str, tail: str = "") -> Unless:
    return Unless(head, guards, tail)


@dataclass(frozen=True)
class Rule:
    """One row of a rule table.

    ``anchors`` are literals of which at least one occurs in every match (in lower case when the
    pattern ignores case); they let a scan skip the regular expression.  ``gate`` is a cheaper
    expression that every match satisfies, for patterns without a literal.  Neither: "always try".
    """

    rule_id: str
    severity: str
    pattern: str | Unless
    description: str
    anchors: tuple[str, ...] = ()
    stack: str | None = None
    scope: str = "line"
    gate: str | None = None
    extra_names: tuple[str, ...] = field(default=())

    @property
    def pack(self) -> str:
        return self.rule_id.split(".", 1)[0]

    @property
    def regex(self) -> str:
        return self.pattern.regex if isinstance(self.pattern, Unless) else self.pattern

    @property
    def ignores_case(self) -> bool:
        return self.regex.startswith("(?i)")


def rule(rule_id, severity, pattern, description, anchors=(), **kw) -> Rule:
    if isinstance(anchors, str):
        anchors = (anchors,)
    return Rule(rule_id, severity, pattern, description, tuple(anchors), **kw)
