"""The chart's zero-cost level as tables that fill themselves.

A position of the chart is a column: the rules opened there with the items waiting for them.  What a token does to the items depends
only on which states they are in, on which of them share an origin, and on the waiting lists of the columns that rules return to;
positions as such play no part.  So each kind of step is worked out once by the chart's own closure and kept as a small decision
tree: a node names the column to look at next, its branches the waiting lists met there, and a leaf holds the new column and the items
after the token.  Every later step of the same kind walks the tree.  The answers are those of the chart.
"""

from __future__ import annotations


class _Items:
    """Items after a token, origins numbered from 1; ``steps`` has the decision tree of each token."""

    __slots__ = ("items", "steps")

    def __init__(self, items: tuple[tuple[int, int], ...]):
        self.items = items
        self.steps: dict[int, _Node] = {}


class _Node:
    """Looks at column ``look`` of those known so far; or, without one, the outcome."""

    __slots__ = ("look", "branches", "waiting", "keeps", "items", "origins", "done")

    def __init__(self) -> None:
        self.look = 0
        self.branches: dict[tuple, _Node] = {}
        self.waiting = 0  # number of the new column's waiting lists
        self.keeps: tuple[int, ...] = ()  # columns they refer to
        self.items: _Items | None = None
        self.origins: tuple[int, ...] = ()
        self.done = False


class LinearParser:
    """Tables of one grammar; ``most`` nodes are kept, then the tables start afresh (answers stay the same)."""

    def __init__(self, parser, guard, most: int = 400_000):
        self._parser, self._guard, self._most = parser, guard, most
        self._clear()

    def _clear(self) -> None:
        net = self._parser.net
        self._tokens: tuple[dict, dict] = ({}, {})
        self._kinds: list[tuple[tuple[str, ...], bool]] = []
        self._waiting: dict[tuple, int] = {}
        self._lists: list[dict[int, tuple[tuple[int, int], ...]]] = []
        self._interned: dict[tuple, _Items] = {}
        self._nodes = 0
        self._start = self._intern(((net.start[net.root], 0),))

    def _intern(self, items: tuple[tuple[int, int], ...]) -> _Items:
        found = self._interned.get(items)
        if found is None:
            found = self._interned[items] = _Items(items)
        return found

    def stop(self, tokens) -> int:
        """Position where no item could go on, or -1 if the text parses."""
        if self._nodes > self._most:
            self._clear()
        plain, broken = self._tokens
        shapes: list[int] = []
        kept: list[list[int]] = []
        current, origins = self._start, []
        i = -1
        for kinds, after_break in zip(tokens.kinds, tokens.breaks):
            i += 1
            token = (broken if after_break else plain).get(kinds)
            if token is None:
                token = self._token(kinds, after_break)
            known = [i, *origins]
            path: list[tuple] = []
            node = current.steps.get(token)
            if node is None:
                node = current.steps[token] = self._grow(current, token, path)
            while node.look:
                column = known[node.look]
                referred = kept[column]
                if len(referred) == 1:
                    at = referred[0]
                    if at in known:
                        step = (shapes[column], known.index(at))
                    else:
                        step = (shapes[column], -1)
                        known.append(at)
                else:
                    key = [shapes[column]]
                    for at in referred:
                        if at in known:
                            key.append(known.index(at))
                        else:
                            key.append(-1)
                            known.append(at)
                    step = tuple(key)
                path.append(step)
                onward = node.branches.get(step)
                if onward is None:
                    onward = node.branches[step] = self._grow(current, token, path)
                node = onward
            current = node.items
            if current is None:
                return -1 if node.done else i
            shapes.append(node.waiting)
            kept.append([known[k] for k in node.keeps])
            origins = [known[k] for k in node.origins]
        return i + 1

    def _token(self, kinds: tuple[str, ...], after_break: bool) -> int:
        self._tokens[after_break][kinds] = len(self._kinds)
        self._kinds.append((kinds, after_break))
        return len(self._kinds) - 1

    def _grow(self, current: _Items, token: int, path: list[tuple]) -> _Node:
        """The chart's closure over numbered columns (0: this one), as far as the waiting lists on ``path`` allow."""
        self._nodes += 1
        parser = self._parser
        net = parser.net
        kinds, after_break = self._kinds[token]
        table = parser._table(kinds)
        one = _One(kinds, after_break)
        count = 1 + max((o for _, o in current.items), default=0)
        opened: dict[int, dict[int, list[tuple[int, int]]]] = {}
        at = 0
        here: dict[int, list[tuple[int, int]]] = {}
        work = list(current.items)
        seen = set(work)
        following: dict[tuple[int, int], None] = {}
        empty: set[int] = set()
        done = False
        node = _Node()
        for state, origin in work:
            shifts, calls, ends, guards = table[state] or parser._move(table, kinds, state)
            for target in shifts:
                following[target, origin] = None
            onward: list[tuple[int, int]] = []
            for rule, start, back in calls:
                callers = here.get(rule)
                if callers is None:
                    here[rule] = [(back, origin)]
                    onward.append((start, 0))
                else:
                    if (back, origin) not in callers:
                        callers.append((back, origin))
                    if rule in empty:
                        onward.append((back, origin))
            if ends >= 0:
                if ends == net.root:
                    done = done or kinds == ("EOF",)
                elif origin == 0:
                    empty.add(ends)
                    onward += here.get(ends, ())
                else:
                    lists = opened.get(origin)
                    if lists is None:
                        if at == len(path):
                            node.look = origin
                            return node
                        shape, *aliases = path[at]
                        at += 1
                        numbers = []
                        for alias in aliases:
                            if alias < 0:
                                alias, count = count, count + 1
                            numbers.append(alias)
                        lists = opened[origin] = {
                            rule: [(back, origin if k == 0 else numbers[k - 1]) for back, k in waiting] for rule, waiting in self._lists[shape].items()
                        }
                    onward += lists.get(ends, ())
            for name, target in guards:
                if (target, origin) not in seen and self._guard(name, one, 0):
                    onward.append((target, origin))
            for item in onward:
                if item not in seen:
                    seen.add(item)
                    work.append(item)
        node.done = done
        if following and kinds != ("EOF",):
            keeps: dict[int, int] = {0: 0}
            lists = {rule: tuple((back, keeps.setdefault(o, len(keeps))) for back, o in waiting) for rule, waiting in here.items()}
            key = tuple(sorted(lists.items()))
            shape = self._waiting.get(key)
            if shape is None:
                shape = self._waiting[key] = len(self._lists)
                self._lists.append(lists)
            node.waiting, node.keeps = shape, tuple(o for o in keeps if o)
            numbers: dict[int, int] = {}
            items = tuple((target, numbers.setdefault(o, len(numbers) + 1)) for target, o in following)
            node.items, node.origins = self._intern(items), tuple(numbers)
        return node


class _One:
    """A single token for the guards."""

    __slots__ = ("kinds", "breaks")

    def __init__(self, kinds: tuple[str, ...], after_break: bool):
        self.kinds, self.breaks = [kinds], [after_break]
