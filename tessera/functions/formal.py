"""Formal text: states of goals and hypotheses, content views, truth tables, name boundaries."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may continue a name, dots and letter-like symbols among it.
WORD = r"\p{L}\p{N}_'!?.\u2100-\u214F"


def whole_name(text: str, name: str) -> Column:
    """The name stands in the text with no name character or dot joined to it on either side; the cheap test comes first."""
    bound = f"(?<![{WORD}]){re.escape(name)}(?![{WORD}])"
    return F.col(text).contains(name) & F.col(text).rlike(bound)


def state_parts(text: str) -> dict[str, list[str]]:
    """Hypotheses and goal of a printed state: lines before the turnstile, and what follows it."""
    head, _, goal = text.partition("⊢")
    return {"hypotheses": [" ".join(x.split()) for x in head.split("\n") if x.strip()], "goal": [" ".join(goal.split())] if goal.strip() else []}


def content_view(text: str, view: str) -> str:
    """The whole state, its goal alone, or its hypotheses alone."""
    parts = state_parts(text)
    lines = {"goal": parts["goal"], "hypotheses": parts["hypotheses"], "state": parts["hypotheses"] + [f"⊢ {g}" for g in parts["goal"]]}[view]
    return "\n".join(lines)


OPERATORS = {"¬": (5, None), "∧": (4, np.logical_and), "∨": (3, np.logical_or), "→": (2, lambda a, b: ~a | b), "↔": (1, lambda a, b: a == b)}
ATOMS = 8


def truth_table(expression: str) -> np.ndarray:
    """Values of a propositional expression over all 256 valuations of p0..p7; → leans right."""
    tokens = re.findall(r"True|False|p\d+|[¬∧∨→↔()]|\S", expression)
    rows = np.arange(256)
    at = 0

    def primary() -> np.ndarray:
        nonlocal at
        t = tokens[at] if at < len(tokens) else ""
        at += 1
        if t == "¬":
            return ~primary()
        if t == "(":
            value = binary(1)
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"no closing bracket in {expression!r}")
            at += 1
            return value
        if t in ("True", "False"):
            return np.full(256, t == "True")
        if re.match(r"p\d+$", t) and int(t[1:]) < ATOMS:
            return (rows >> int(t[1:])) & 1 == 1
        raise ValueError(f"unexpected {t!r} in {expression!r}")

    def binary(least: int) -> np.ndarray:
        nonlocal at
        left = primary()
        while at < len(tokens) and tokens[at] in OPERATORS and OPERATORS[tokens[at]][1] is not None and OPERATORS[tokens[at]][0] >= least:
            rank, fn = OPERATORS[tokens[at]]
            op = tokens[at]
            at += 1
            left = fn(left, binary(rank if op == "→" else rank + 1))
        return left

    value = binary(1)
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in {expression!r}")
    return value


def truth_vector(expression: Column) -> Column:
    """Unit vectors of the values; equivalent expressions have equal ones."""
    values = F.pandas_udf(lambda v: v.map(lambda e: np.where(truth_table(e), 1.0, -1.0) / 16), "array<double>")
    return values(expression)


def viewed(text: Column, view: str) -> Column:
    return F.pandas_udf(lambda v: v.map(lambda x: content_view(x, view)), "string")(text)


#: Fixed words that name no concept: sorts, binders of universes, and the mark of an inaccessible name.
NO_CONCEPT = re.compile(r"(?:Type|Sort|Prop|fun|[uvw](?:_\d+)?|✝)\Z")
TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_.']*|[^\x00-\x7f\s]")


def concepts(text: str) -> set[str]:
    """What a printed state speaks of: the names in its goal and in the types of its hypotheses, without the names that the hypotheses bind.

    A line `names : type` binds its names; of instances only these count. A name behind a bound one and a dot is the
    concept by itself; dots at the end of a name don't belong to it.
    """
    bound, spoken = set(), []
    for line in text.split("\n"):
        names, colon, kind = line.partition(" : ")
        if line.startswith("⊢"):
            spoken.append(line[1:])
        elif not colon or not names or names[0].isspace():
            spoken.append(line)
        else:
            bound.update(TOKEN.findall(names))
            if not names.startswith("inst"):
                spoken.append(kind)
    found = (t.rstrip(".") for s in spoken for t in TOKEN.findall(s))
    parts = ((t, *t.partition(".")) for t in found)
    bare = {rest if rest and head in bound else t for t, head, _, rest in parts}
    return {t for t in bare if t and t not in bound and not NO_CONCEPT.match(t)}


def concept_lists(text: str | Column) -> Column:
    """Sorted concepts of each state, in Arrow batches."""
    return F.pandas_udf(lambda v: v.map(lambda s: sorted(concepts(s or ""))), "array<string>")(text)
