"""Context-free grammars written as extended rules and compiled to recursive transition networks.

Notation: ``name = body`` one rule per line (continuation lines are indented); ``|`` alternatives, ``[ ]`` optional, ``{ }`` repeated,
``( )`` grouping.  ``'x'`` and ``UPPER`` are terminals, ``~guard`` is a test of the position that
consumes nothing.  Each rule becomes a deterministic automaton over terminals, guards and rule names, so repetition needs
no recursion and shared prefixes are shared states.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"\s*(?:('(?:[^'])+')|([A-Za-z_~][A-Za-z_0-9]*)|([\[\]{}()|]))")


class _Nfa:
    """Thompson construction; edges are (symbol or None, target)."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[str | None, int]]] = []

    def node(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def link(self, a: int, b: int, symbol: str | None = None) -> None:
        self.edges[a].append((symbol, b))


class _Reader:
    def __init__(self, text: str, nfa: _Nfa):
        self.items = [next(x for x in m.groups() if x) for m in _TOKEN.finditer(text)]
        self.at, self.nfa = 0, nfa

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def alternatives(self) -> tuple[int, int]:
        start, end = self.nfa.node(), self.nfa.node()
        while True:
            a, b = self.sequence()
            self.nfa.link(start, a)
            self.nfa.link(b, end)
            if self.peek() != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.node()
        while (item := self.peek()) is not None and item not in ("|", ")", "]", "}"):
            self.at += 1
            if item in ("(", "[", "{"):
                a, b = self.alternatives()
                self.at += 1  # the closing mark
                if item == "{":
                    self.nfa.link(b, a)
                if item != "(":
                    self.nfa.link(a, b)
            else:
                a, b = self.nfa.node(), self.nfa.node()
                self.nfa.link(a, b, item)
            self.nfa.link(end, a)
            end = b
        return start, end


@dataclass
class Network:
    """A compiled grammar.  States are numbered over all rules."""

    rule_of: list[int]
    accepts: list[bool]
    terminal: list[dict[str, int]]
    guard: list[list[tuple[str, int]]]
    calls: list[list[tuple[int, int]]]
    start: list[int]
    first: list[set[str]]
    follow: list[set[str]]
    names: list[str]
    soft: list[bool]
    root: int


def compile_grammar(text: str, root: str) -> Network:
    rules: dict[str, str] = {}
    name = ""
    for line in text.strip("\n").split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0].isspace():
            rules[name] += " " + line.strip()
        else:
            name, _, body = line.partition("=")
            name = name.strip()
            rules[name] = body.strip()
    names = list(rules)
    number = {n: i for i, n in enumerate(names)}
    automata = [_automaton(rules[n], number) for n in names]
    nullable = [False] * len(names)
    # rules that can be empty are replaced at their uses by "rule or nothing"
    changed = True
    while changed:
        changed = False
        for i, (edges, start, end) in enumerate(automata):
            if not nullable[i] and end in _closure(edges, {start}, nullable):
                nullable[i] = changed = True
    net = Network([], [], [], [], [], [0] * len(names), [set() for _ in names], [set() for _ in names], names, [False] * len(names), number[root])
    for i, (edges, start, end) in enumerate(automata):
        _determinise(net, i, edges, start, end, nullable)
    _soft_rules(net)
    _first_sets(net)
    _follow_sets(net)
    return net


def _automaton(body: str, number: dict[str, int]) -> tuple[list, int, int]:
    nfa = _Nfa()
    reader = _Reader(body, nfa)
    start, end = reader.alternatives()
    assert reader.peek() is None, body
    edges: list[list[tuple[object, int]]] = []
    for out in nfa.edges:
        row: list[tuple[object, int]] = []
        for symbol, target in out:
            if symbol is None:
                row.append((None, target))
            elif symbol in number:
                row.append((number[symbol], target))
            elif symbol[0] == "'":
                row.append((symbol[1:-1], target))
            elif symbol[0] == "~" or symbol.isupper() or symbol.replace("_", "").isupper():
                row.append((symbol, target))
            else:
                raise KeyError(f"{symbol} in {body}")
        edges.append(row)
    return edges, start, end


def _closure(edges: list, nodes: set[int], nullable: list[bool]) -> frozenset[int]:
    todo, seen = list(nodes), set(nodes)
    while todo:
        for symbol, target in edges[todo.pop()]:
            if target not in seen and (symbol is None or (isinstance(symbol, int) and nullable[symbol])):
                seen.add(target)
                todo.append(target)
    return frozenset(seen)


def _determinise(net: Network, rule: int, edges: list, start: int, end: int, nullable: list[bool]) -> None:
    first = _closure(edges, {start}, nullable)
    known = {first: len(net.rule_of)}
    net.start[rule] = known[first]

    def add(nodes: frozenset[int]) -> None:
        net.rule_of.append(rule)
        net.accepts.append(end in nodes)
        net.terminal.append({})
        net.guard.append([])
        net.calls.append([])

    add(first)
    todo = [first]
    while todo:
        nodes = todo.pop()
        state = known[nodes]
        by: dict[object, set[int]] = {}
        for n in nodes:
            for symbol, target in edges[n]:
                if symbol is not None:
                    by.setdefault(symbol, set()).add(target)
        for symbol, targets in by.items():
            reached = _closure(edges, targets, nullable)
            if reached not in known:
                known[reached] = len(net.rule_of)
                add(reached)
                todo.append(reached)
            target = known[reached]
            if isinstance(symbol, int):
                net.calls[state].append((symbol, target))
            elif symbol[0] == "~" and len(symbol) > 1:
                net.guard[state].append((symbol, target))
            else:
                net.terminal[state][symbol] = target


def _ends(net: Network, state: int, seen: set[int]) -> bool:
    """Whether the rule can end here without a token: guards and rules of guards only are passed over."""
    if net.accepts[state]:
        return True
    seen.add(state)
    onward = [t for _, t in net.guard[state]] + [t for r, t in net.calls[state] if net.soft[r]]
    return any(_ends(net, t, seen) for t in onward if t not in seen)


def _soft_rules(net: Network) -> None:
    """Rules that can match no token although they are not empty: a guard decides."""
    changed = True
    while changed:
        changed = False
        for rule, start in enumerate(net.start):
            if not net.soft[rule] and not net.accepts[start] and _ends(net, start, set()):
                net.soft[rule] = changed = True


def _leads(net: Network, state: int, seen: set[int]) -> set[str]:
    """Terminals that can come next in a state, guards and soft rules passed over."""
    out = set(net.terminal[state])
    onward = [t for _, t in net.guard[state]]
    for rule, target in net.calls[state]:
        out |= net.first[rule]
        if net.soft[rule]:
            onward.append(target)
    for target in onward:
        if target not in seen:
            seen.add(target)
            out |= _leads(net, target, seen)
    return out


def _first_sets(net: Network) -> None:
    changed = True
    while changed:
        changed = False
        for rule, start in enumerate(net.start):
            found = _leads(net, start, {start})
            if not found <= net.first[rule]:
                net.first[rule] |= found
                changed = True


def _follow_sets(net: Network) -> None:
    net.follow[net.root].add("EOF")
    changed = True
    while changed:
        changed = False
        for state in range(len(net.rule_of)):
            for rule, target in net.calls[state]:
                found = _leads(net, target, {target})
                if _ends(net, target, set()):
                    found = found | net.follow[net.rule_of[state]]
                if not found <= net.follow[rule]:
                    net.follow[rule] |= found
                    changed = True
