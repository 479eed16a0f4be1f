"""Captures from syntax trees by query texts of nested node patterns.

A query holds patterns such as `(call (identifier) @name (_)*) @call`: a type or `_` in brackets,
child patterns that match children in order (not necessarily next to each other), a field name
before a child (which trees without fields take for granted), `?`, `*` and `+` behind a child,
alternatives in square brackets, `"text"` for a node without children of that type, and captures
behind a pattern. `(#eq? @a "x")`, `(#not-eq? ..)`, `(#match? @a "re")`, `(#not-match? ..)` and
`(#any-of? @a "x" "y")` inside a pattern filter its matches; a second capture may stand for the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r'\s+|;[^\n]*|(?P<open>[(\[])|(?P<close>[)\]])|(?P<text>"(?:\\.|[^"\\])*")|(?P<capture>@[\w.-]+)|(?P<predicate>#[\w-]+[?!]?)|(?P<field>!?[\w-]+:)|(?P<quantity>[?*+])|(?P<anchor>\.)|(?P<name>[\w-]+)')


@dataclass
class Pattern:
    """One node pattern; `kinds` is None for any type, alternatives make a pattern of their own."""

    kinds: frozenset[str] | None = None
    children: list[Pattern] = field(default_factory=list)
    alternatives: list[Pattern] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    quantity: str = ""
    leaf: bool = False
    predicates: list[tuple[str, list[tuple[str, str]]]] = field(default_factory=list)


def parse_query(query: str) -> list[Pattern]:
    """The patterns of a query text; ValueError where it is not one."""
    tokens, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"unexpected text at {at}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    done, place = parse_patterns(tokens, 0, "")
    if place != len(tokens):
        raise ValueError("an unexpected bracket")
    return done


def parse_patterns(tokens: list[tuple[str, str]], at: int, end: str) -> tuple[list[Pattern], int]:
    """Patterns from token `at` up to the bracket `end`."""
    found: list[Pattern] = []
    while at < len(tokens):
        kind, text = tokens[at]
        if kind == "close":
            if text != end:
                raise ValueError(f"unexpected {text}")
            return found, at
        if kind == "open" and text == "(":
            if at + 1 < len(tokens) and tokens[at + 1][0] == "predicate":
                name, given, at = tokens[at + 1][1], [], at + 2
                while at < len(tokens) and tokens[at][0] != "close":
                    given.append((tokens[at][0], tokens[at][1]))
                    at += 1
                if not found and not end:
                    raise ValueError("a predicate without a pattern")
                # A predicate belongs to the pattern around it, or to the one before it at the top.
                holder = Pattern(predicates=[(name, given)]) if end else found[-1]
                if end:
                    found.append(holder)
                else:
                    holder.predicates.append((name, given))
                at += 1
                continue
            own = Pattern()
            at += 1
            if at < len(tokens) and tokens[at][0] == "name":
                own.kinds = None if tokens[at][1] == "_" else frozenset([tokens[at][1]])
                at += 1
            below, at = parse_patterns(tokens, at, ")")
            own.predicates = [p for c in below for p in c.predicates if _is_predicate(c)]
            own.children = [c for c in below if not _is_predicate(c)]
            found.append(own)
        elif kind == "open":
            below, at = parse_patterns(tokens, at + 1, "]")
            found.append(Pattern(alternatives=below))
        elif kind == "text":
            found.append(Pattern(kinds=frozenset([json.loads(text)]), leaf=True))
        elif kind == "name" and text == "_":
            found.append(Pattern())
        elif kind == "capture" and found:
            found[-1].captures.append(text[1:])
        elif kind == "quantity" and found:
            found[-1].quantity = text
        elif kind not in ("field", "anchor"):
            raise ValueError(f"unexpected {text}")
        at += 1
    if end:
        raise ValueError(f"a missing {end}")
    return found, at


def _is_predicate(p: Pattern) -> bool:
    return bool(p.predicates) and p.kinds is None and not (p.children or p.alternatives or p.captures)


Capture = tuple[str, dict]


def _below(node: dict) -> list[dict]:
    below = node.get("children")
    return [c for c in below if isinstance(c, dict)] if isinstance(below, list) else []


def matches_at(pattern: Pattern, node: dict) -> Iterator[list[Capture]]:
    """The captures of every way in which a pattern matches a node."""
    if pattern.alternatives:
        for own in pattern.alternatives:
            for found in matches_at(own, node):
                yield [(c, node) for c in pattern.captures] + found
        return
    if pattern.kinds is not None and str(node.get("type", "")) not in pattern.kinds or pattern.leaf and _below(node):
        return
    own = [(c, node) for c in pattern.captures]
    for found in _sequence(pattern.children, _below(node)):
        whole = own + found
        if all(_holds(p, whole) for p in pattern.predicates):
            yield whole


def _sequence(patterns: list[Pattern], nodes: list[dict]) -> Iterator[list[Capture]]:
    if not patterns:
        yield []
        return
    head, rest = patterns[0], patterns[1:]
    if head.quantity in ("*", "+"):
        # All children that match belong to it; what follows starts behind the first.
        every = [(i, next(matches_at(head, n), None)) for i, n in enumerate(nodes)]
        every = [(i, f) for i, f in every if f is not None]
        if every or head.quantity == "*":
            start = every[0][0] + 1 if every and rest else 0
            for tail in _sequence(rest, nodes[start:]):
                yield [c for _, f in every for c in f] + tail
        return
    hit = False
    for i, node in enumerate(nodes):
        for found in matches_at(head, node):
            for tail in _sequence(rest, nodes[i + 1 :]):
                hit = True
                yield found + tail
    if head.quantity == "?" and not hit:
        yield from _sequence(rest, nodes)


def _holds(predicate: tuple[str, list[tuple[str, str]]], found: list[Capture]) -> bool:
    name, given = predicate
    texts = lambda c: [str(n.get("text", "")) for x, n in found if x == c[1:]]
    if not given or given[0][0] != "capture":
        return True
    own = texts(given[0][1])
    wanted = [json.loads(t) if kind == "text" else (texts(t) or [""])[0] if kind == "capture" else t for kind, t in given[1:]]
    if not own or not wanted:
        return True
    test = {
        "eq": lambda t: t == wanted[0], "match": lambda t: re.search(wanted[0], t) is not None, "any-of": lambda t: t in wanted,
    }.get(name.strip("#?!").removeprefix("not-"))
    if test is None:
        return True  # what is not known does not filter
    return all(test(t) != name.startswith("#not-") for t in own)


def tree_captures(df: DataFrame, key: str, tree: str, queries: dict[str, str]) -> DataFrame:
    """(key, query, match, capture, node, type, text): the captures of every match in JSON syntax trees.

    Matches are numbered per tree and query in the order of their first node, nodes as in
    `tree_nodes`. A query that is not well formed matches nothing; trees that are null or not valid
    JSON have no captures.
    """
    key_type = df.schema[key].dataType.simpleString()
    parsed = {}
    for name, query in queries.items():
        try:
            parsed[name] = parse_query(query)
        except ValueError:
            continue

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = json.loads(raw) if raw else None
                except (ValueError, RecursionError):
                    continue
                nodes, stack = [], [root]
                while stack:
                    node = stack.pop()
                    if isinstance(node, dict):
                        nodes.append(node)
                        stack.extend(reversed(_below(node)))
                numbers = {id(n): i for i, n in enumerate(nodes)}
                for name, patterns in parsed.items():
                    count = 0
                    for node in nodes:
                        for pattern in patterns:
                            for found in matches_at(pattern, node):
                                for capture, at in found:
                                    text = at.get("text")
                                    keys.append(k)
                                    rows.append((name, count, capture, numbers[id(at)], str(at.get("type", "")), text if isinstance(text, str) else None))
                                count += 1
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, "query", "match", "capture", "node", "type", "text"])

    return df.select(key, tree).mapInArrow(search, f"`{key}` {key_type}, query string, match long, capture string, node long, type string, text string")
