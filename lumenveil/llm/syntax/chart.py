"""Chart parsing of token sequences, with minimum-cost repair.

The chart holds, for every position, the items (state, origin) of a transition network that the tokens so far allow.  Without edits the
items cost nothing and the chart decides whether a text parses.  Where the items die out, the chart is continued at
rising cost: a token may be dropped, replaced, or put in, each for one edit, and items are kept at their least cost.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from lumenveil.llm.syntax.grammar import Network
from lumenveil.llm.syntax.linear import LinearParser


@dataclass
class Tokens:
    """Terminals of each token (a word may count as several), line of each, and guard values by name."""

    kinds: list[tuple[str, ...]] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)
    breaks: list[bool] = field(default_factory=list)

    def add(self, kind: tuple[str, ...], line: int, after_break: bool = False) -> None:
        if kind == ("BAD",) and self.kinds and self.kinds[-1] == kind and self.lines[-1] == line:
            return  # a run of stray characters is one token
        self.kinds.append(kind)
        self.lines.append(line)
        self.breaks.append(after_break)


@dataclass(frozen=True)
class Edit:
    """One edit, ``drop``, ``put`` or ``swap``, of a terminal on a line; ``last``: at the end of the text."""

    action: str
    line: int
    terminal: str
    last: bool


def _guard(name: str, tokens: Tokens, i: int) -> bool:
    kinds = tokens.kinds[i]
    if name == "~asi":  # a statement may end without a semicolon
        return tokens.breaks[i] or kinds[0] in ("}", "EOF")
    if name == "~nl":  # a line break lies before the token
        return tokens.breaks[i] or kinds[0] == "EOF"
    if name == "~sameline":
        return not tokens.breaks[i]
    if name == "~nobrace":  # not the start of a block, function or class
        return kinds[0] not in ("{", "function", "class")
    if name == "~nofun":
        return kinds[0] not in ("function", "class", "interface", "abstract")
    raise KeyError(name)


class Parser:
    """Chart parser of one grammar; transition tables per (state, token) are filled as they are met."""

    def __init__(self, net: Network):
        self.net = net
        self._moves: dict[tuple[str, ...], list] = {}
        self._linear = LinearParser(self, _guard)

    def _table(self, kinds: tuple[str, ...]) -> list:
        table = self._moves.get(kinds)
        if table is None:
            table = self._moves[kinds] = [None] * len(self.net.rule_of)
        return table

    def _move(self, table: list, kinds: tuple[str, ...], state: int) -> tuple:
        """(next states over the token, rules to open with their return states, rule that may end or -1, guards)."""
        net = self.net
        shifts = tuple(dict.fromkeys(net.terminal[state][k] for k in kinds if k in net.terminal[state]))
        calls = tuple((r, net.start[r], back) for r, back in net.calls[state] if net.soft[r] or any(k in net.first[r] for k in kinds))
        rule = net.rule_of[state]
        ends = rule if net.accepts[state] and any(k in net.follow[rule] for k in kinds) else -1
        table[state] = out = (shifts, calls, ends, tuple(net.guard[state]))
        return out

    def run(self, tokens: Tokens, keep: bool = False) -> tuple[int, list, list]:
        """(position where no item could go on, or -1 if the text parses; item sets; waiting lists)."""
        net = self.net
        root_start = net.start[net.root]
        items: list[tuple[int, int]] = [(root_start, 0)]
        waiting: list[dict[int, list[tuple[int, int]]]] = []
        sets: list[list[tuple[int, int]]] = []
        n = len(tokens.kinds)
        for i in range(n):
            items, following, done = self._step(tokens, i, items, waiting)
            if keep:
                sets.append(items)
            if tokens.kinds[i] == ("EOF",):
                return (-1 if done else i), sets, waiting
            if not following:
                return i, sets, waiting
            items = following
        return n, sets, waiting

    def _step(self, tokens: Tokens, i: int, items: list, waiting: list) -> tuple[list, list, bool]:
        kinds = tokens.kinds[i]
        table = self._table(kinds)
        here: dict[int, list[tuple[int, int]]] = {}
        waiting.append(here)
        seen = set(items)
        work = list(items)
        following: list[tuple[int, int]] = []
        ahead: set[tuple[int, int]] = set()
        done = False
        empty: set[int] = set()
        root, at_end = self.net.root, kinds == ("EOF",)
        move = self._move
        k = 0
        while k < len(work):
            state, origin = work[k]
            k += 1
            entry = table[state]
            if entry is None:
                entry = move(table, kinds, state)
            shifts, calls, ends, guards = entry
            for target in shifts:
                item = (target, origin)
                if item not in ahead:
                    ahead.add(item)
                    following.append(item)
            for rule, start, back in calls:
                callers = here.get(rule)
                if callers is None:
                    here[rule] = [(back, origin)]
                    item = (start, i)
                    if item not in seen:
                        seen.add(item)
                        work.append(item)
                else:
                    callers.append((back, origin))
                    if rule in empty:
                        item = (back, origin)
                        if item not in seen:
                            seen.add(item)
                            work.append(item)
            if ends >= 0:
                if ends == root and origin == 0 and at_end:
                    done = True
                if origin == i:
                    empty.add(ends)
                if origin < i or ends in here:
                    for item in waiting[origin].get(ends, ()):
                        if item not in seen:
                            seen.add(item)
                            work.append(item)
            for name, target in guards:
                item = (target, origin)
                if item not in seen and _guard(name, tokens, i):
                    seen.add(item)
                    work.append(item)
        return work, following, done

    def stop(self, tokens: Tokens) -> int:
        """As ``run``, by tables of the steps met so far; only the position."""
        return self._linear.stop(tokens)

    def parses(self, tokens: Tokens) -> bool:
        return self.stop(tokens) < 0

    def repair(self, tokens: Tokens) -> Repair:
        """Repair of least cost over the whole text; the cost is zero exactly for texts that parse.

        A quick repair, error by error, gives an upper bound; stretches that occur in no text of the grammar give a lower one.  Between them
        the chart is searched for the least cost with rising limits, until a repair is found or the upper bound is known to be least.
        """
        stop = self.run(tokens)[0]
        if stop < 0:
            return Repair(0, [], True)
        quick, certain = self._quick(tokens)
        rest = self._unavoidable(tokens, stop)
        limit, step = rest[0], 1
        while not (certain and quick.cost <= limit):
            if certain:
                limit = min(limit, quick.cost - 1)
            found = self._search(tokens, limit, rest)
            if found is not None:
                return quick if quick.cost == found.cost else found
            if certain and limit == quick.cost - 1:
                break
            limit, step = limit + step, 2 * step
        return quick

    def _quick(self, tokens: Tokens, region: int = 12, ahead: int = 8) -> tuple[Repair, bool]:
        """(repair error by error, whether its edited text is known to parse); its cost is an upper bound.

        Where the chart stops, every single edit at one of the last ``region`` positions, and dropping the rest of the offending
        line, is tried on the chart's own items; the cheapest that lets ``ahead`` more tokens parse, and of these the one
        that gets furthest, is kept.  If none does, the offending token is dropped.  At the end of the text the least number of
        tokens that completes any item is put in, without a look at guards.
        """
        current = Tokens(list(tokens.kinds), list(tokens.lines), list(tokens.breaks))
        edits: list[Edit] = []
        waiting: list = []
        following: list = []
        at = 0
        while True:
            stop, done = self._advance(current, at, waiting, following)
            if done:
                return Repair(len(edits), edits, True), True
            line = current.lines[stop]
            if current.kinds[stop] == ("EOF",):
                missing = self._completion(current, stop, waiting, following)
                edits += [Edit("put", line, "?", True)] * missing
                return Repair(len(edits), edits, True), False
            position, changes = self._cheapest(current, stop, waiting, following, region, ahead)
            for action, place, terminal in changes:
                here = current.lines[place]
                last = place >= len(current.kinds) - 2 or current.kinds[stop + 1 : stop + 2] == [("EOF",)]
                edits.append(Edit(action, here, terminal or current.kinds[place][0], last))
                _edit(current, action, place, terminal)
            at = min(position, len(following))
            del waiting[at:], following[at:]

    def _unavoidable(self, tokens: Tokens, stop: int) -> list[int]:
        """Per position the number of disjoint stretches from there on that no text of the grammar contains; each needs an edit."""
        n = len(tokens.kinds)
        rest = [0] * (n + 1)
        starts = [0]
        at = stop + 1
        while at < n:
            end = self._dies(tokens, at)
            if end < 0:
                break
            starts.append(at)
            at = end + 1
        for start in starts:
            rest[start] += 1
        for i in range(n - 1, -1, -1):
            rest[i] += rest[i + 1]
        return rest

    def _dies(self, tokens: Tokens, start: int) -> int:
        """Position where the stretch from ``start`` can no longer be part of a text of the grammar, -1 if it can be its end."""
        net = self.net
        backs = getattr(self, "_backs", None)
        if backs is None:
            backs = self._backs = [[] for _ in net.start]
            for calls in net.calls:
                for rule, back in calls:
                    if back not in backs[rule]:
                        backs[rule].append(back)
        n = len(tokens.kinds)
        items = [(s, -1) for s in range(len(net.rule_of))]  # origin -1: before the stretch
        waiting: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i in range(start, n):
            kinds = tokens.kinds[i]
            table = self._table(kinds)
            here: dict[int, list[tuple[int, int]]] = {}
            waiting[i] = here
            seen, work, ahead = set(items), list(items), set()
            empty: set[int] = set()
            at_end = kinds == ("EOF",)
            for state, origin in work:
                shifts, calls, ends, guards = table[state] or self._move(table, kinds, state)
                ahead.update((target, origin) for target in shifts)
                onward: list[tuple[int, int]] = []
                for rule, first, back in calls:
                    here.setdefault(rule, []).append((back, origin))
                    onward.append((first, i))
                    if rule in empty:
                        onward.append((back, origin))
                if ends >= 0:
                    if at_end and ends == net.root and origin < 0:
                        return -1
                    if origin == i:
                        empty.add(ends)
                    onward += [(back, -1) for back in backs[ends]] if origin < 0 else waiting[origin].get(ends, ())
                onward += [(target, origin) for name, target in guards if _guard(name, tokens, i)]
                for item in onward:
                    if item not in seen:
                        seen.add(item)
                        work.append(item)
            if not ahead:
                return i
            items = list(ahead)
        return -1

    def _targets(self) -> list[list[tuple[int, tuple[str, ...]]]]:
        """Per state (next state, terminals that lead to it)."""
        held = getattr(self, "_targets_held", None)
        if held is None:
            held = []
            for row in self.net.terminal:
                by: dict[int, list[str]] = {}
                for terminal, target in row.items():
                    if terminal not in ("NEVER", "EOF"):
                        by.setdefault(target, []).append(terminal)
                held.append([(target, tuple(sorted(names))) for target, names in by.items()])
            self._targets_held = held
        return held

    def _search(self, tokens: Tokens, limit: int, rest: list[int]) -> Repair | None:
        """Repair of least cost if that is at most ``limit``.

        Items are (state, origin, guards the next token must pass).  Each position is worked off by rising cost of the
        text before it; an item is dropped only if its cost and the edits unavoidable after it exceed the limit.  An origin is a
        position together with the guards pending there, so that rules return to callers with the same pending guards.
        """
        net = self.net
        rule_of, accepts, root = net.rule_of, net.accepts, net.root
        targets = self._targets()
        n = len(tokens.kinds)
        waiting: list[dict[int, list]] = [{}]  # by origin: rule -> (cost, state to return to, its origin, caller), by rising cost
        opened: list[dict[int, int]] = [{root: 0}]  # by origin: least cost of the text before a rule opened there
        column = [0]
        none: frozenset[str] = frozenset()
        kernel: dict[tuple, int] = {(net.start[root], 0, none): 0}
        how: list[dict[tuple, tuple]] = [{(net.start[root], 0, none): ("start",)}]
        passes: dict[tuple, bool] = {}

        def fits(guards: frozenset[str], kinds: tuple[str, ...], after_break: bool) -> bool:
            key = (guards, kinds, after_break)
            found = passes.get(key)
            if found is None:
                one = Tokens([kinds], [0], [after_break])
                found = passes[key] = all(_guard(name, one, 0) for name in guards)
            return found

        for i in range(n):
            kinds, after_break = tokens.kinds[i], tokens.breaks[i]
            at_end = kinds == ("EOF",)
            table = self._table(kinds)
            most, most_next = limit - rest[i], limit - rest[i + 1]
            least = dict(kernel)
            ways = how[i]
            buckets: list[list[tuple]] = [[] for _ in range(most + 1)]
            for item, cost in kernel.items():
                if cost <= most:
                    buckets[cost].append(item)
            following: dict[tuple, int] = {}
            onward: dict[tuple, tuple] = {}
            first_here = len(waiting)
            origins: dict[frozenset[str], int] = {}
            ended: dict[tuple[int, int], list] = {}
            final: set[tuple] = set()

            def reach(item: tuple, cost: int, way: tuple) -> None:
                if cost <= most and cost < least.get(item, limit + 1):
                    least[item] = cost
                    ways[item] = way
                    buckets[cost].append(item)

            def pass_on(item: tuple, cost: int, way: tuple) -> None:
                if cost <= most_next and cost < following.get(item, limit + 1):
                    following[item] = cost
                    onward[item] = way

            for cost in range(most + 1):
                for item in buckets[cost]:
                    if item in final:
                        continue
                    final.add(item)
                    state, origin, guards = item
                    rule = rule_of[state]
                    may_edit = cost < most_next
                    fit = not guards or fits(guards, kinds, after_break)
                    if not may_edit and not fit:
                        continue
                    shifts, calls, ends, tests = table[state] or self._move(table, kinds, state)
                    if fit and not at_end:
                        for target in shifts:
                            pass_on((target, origin, none), cost, ("shift", item))
                    if may_edit:
                        for target, names in targets[state]:
                            if not at_end:
                                swap = next((t for t in names if not guards or fits(guards, (t,), after_break)), None)
                                if swap is not None:
                                    pass_on((target, origin, none), cost + 1, ("swap", item, swap))
                            put = next((t for t in names if not guards or fits(guards, (t,), False)), None)
                            if put is not None:
                                reach((target, origin, none), cost + 1, ("put", item, put))
                        if not at_end and kernel.get(item) == cost:  # drops come before anything else at a position
                            pass_on(item, cost + 1, ("drop", item))
                        calls = [(r, net.start[r], back) for r, back in net.calls[state]]
                    if calls:
                        here = origins.get(guards)
                        if here is None:
                            here = origins[guards] = len(waiting)
                            waiting.append({})
                            opened.append({})
                            column.append(i)
                        for r, first, back in calls:
                            waiting[here].setdefault(r, []).append((cost, back, origin, item))
                            if r not in opened[here]:
                                opened[here][r] = cost
                                reach((first, here, guards), cost, ("start",))
                            for inside, pending, done in ended.get((here, r), ()):
                                reach((back, origin, pending), cost + inside, ("return", item, i, done))
                    if accepts[state] and (may_edit or ends >= 0):
                        if rule == root and origin == 0 and at_end and fit:
                            return Repair(cost, self._edits(tokens, how, column, i, item), True)
                        inside = cost - opened[origin][rule]
                        if origin >= first_here:
                            ended.setdefault((origin, rule), []).append((inside, guards, item))
                        for before, back, outer, caller in waiting[origin].get(rule, ()):
                            if before + inside > most:
                                break
                            reach((back, outer, guards), before + inside, ("return", caller, column[origin], item))
                    for name, target in net.guard[state]:
                        if may_edit or _guard(name, tokens, i):
                            reach((target, origin, guards | {name}), cost, ("test", item))
            kernel = following
            how.append(onward)
            if not kernel:
                return None
        return None

    def _edits(self, tokens: Tokens, how: list[dict], column: list[int], i: int, item: tuple) -> list[Edit]:
        """The edits that led to an item, in the order of the text."""
        found: list[tuple[int, int, Edit]] = []
        todo = [(i, item)]
        count = 0
        while todo:
            at, item = todo.pop()
            way = how[at][item]
            if way[0] == "return":
                todo += [(way[2], way[1]), (at, way[3])]
            elif way[0] in ("test", "put"):
                todo.append((at, way[1]))
            elif way[0] != "start":
                todo.append((at - 1, way[1]))
            if way[0] in ("put", "swap", "drop"):
                place = at if way[0] == "put" else at - 1
                count += 1
                terminal = way[2] if len(way) > 2 else tokens.kinds[place][0]
                found.append((place, -count, Edit(way[0], tokens.lines[place], terminal, place >= len(tokens.kinds) - 2)))
        return [edit for _, _, edit in sorted(found, key=lambda f: f[:2])]

    def _advance(self, tokens: Tokens, at: int, waiting: list, following: list, limit: int | None = None) -> tuple[int, bool]:
        """Run from ``at``, growing ``waiting`` and ``following``; (position of the stop, whether the text parsed)."""
        items = following[at - 1] if at else [(self.net.start[self.net.root], 0)]
        n = len(tokens.kinds)
        for i in range(at, n):
            _, ahead, done = self._step(tokens, i, items, waiting)
            if not ahead:
                waiting.pop()
                return i, done
            following.append(ahead)
            items = ahead
            if limit is not None and i >= limit:
                return i + 1, False
        return n, False

    def _cheapest(self, tokens: Tokens, stop: int, waiting: list, following: list, region: int, ahead: int) -> tuple[int, list]:
        """(position to resume from, edits) of the cheapest repair around ``stop``."""
        goal = stop + ahead
        best: tuple[int, int, int, list] | None = None
        for position in range(stop, max(0, stop - region) - 1, -1):
            items = following[position - 1] if position else [(self.net.start[self.net.root], 0)]
            probe = waiting[:position]
            closed, _, _ = self._closure(tokens, position, items, probe)
            wanted = {t for state, _ in closed for t in self.net.terminal[state]} - {"NEVER"}
            actions = [("drop", "")] if tokens.kinds[position] != ("EOF",) else []
            for terminal in sorted(wanted):
                actions.append(("put", terminal))
                if terminal not in tokens.kinds[position]:
                    actions.append(("swap", terminal))
            for action, terminal in actions:
                reach = self._try(tokens, [(action, position, terminal)], position, waiting, following, goal)
                if reach > goal or reach < 0:
                    far = len(tokens.kinds) + 1 if reach < 0 else reach
                    if best is None or (-far, stop - position) < (-best[1], stop - best[2]):
                        best = (1, far, position, [(action, position, terminal)])
            if best is not None and best[1] > len(tokens.kinds):
                break
        if best is not None:
            return best[2], best[3]
        # the whole rest of the line, from its first token
        line = tokens.lines[stop]
        first = stop
        while first > 0 and tokens.lines[first - 1] == line and tokens.kinds[first - 1] not in (("NEWLINE",), ("INDENT",), ("DEDENT",)):
            first -= 1
        last = stop
        while last + 1 < len(tokens.kinds) and tokens.lines[last + 1] == line and tokens.kinds[last + 1] != ("EOF",):
            last += 1
        for start in dict.fromkeys((first, stop)):
            changes = [("drop", p, "") for p in range(last, start - 1, -1)]
            if tokens.kinds[last] != ("EOF",) and self._try(tokens, changes, start, waiting, following, start + ahead // 2) not in range(0, start + ahead // 2):
                return start, changes
        return stop, [("drop", stop, "")]

    def _closure(self, tokens: Tokens, i: int, items: list, waiting: list) -> tuple[list, list, bool]:
        """The full item set at a position for any next token: all rules that could open there."""
        seen = set(items)
        work = list(items)
        k = 0
        here: dict[int, list] = {}
        while k < len(work):
            state, origin = work[k]
            k += 1
            for rule, back in self.net.calls[state]:
                here.setdefault(rule, []).append((back, origin))
                targets = [(self.net.start[rule], i)] + ([(back, origin)] if self.net.soft[rule] else [])
                for item in targets:
                    if item not in seen:
                        seen.add(item)
                        work.append(item)
            onward = [(t, origin) for _, t in self.net.guard[state]]
            if self.net.accepts[state] and origin < i:
                onward += waiting[origin].get(self.net.rule_of[state], ())
            for item in onward:
                if item not in seen:
                    seen.add(item)
                    work.append(item)
        return work, [], False

    def _try(self, tokens: Tokens, changes: list, position: int, waiting: list, following: list, goal: int) -> int:
        """How far the edited text parses, resumed at ``position`` and followed to ``goal``; -1 if to its end."""
        window = 2 * (goal - position) + 24
        trial = Tokens(tokens.kinds[position : position + window], tokens.lines[position : position + window], tokens.breaks[position : position + window])
        shift = 0
        for action, place, terminal in changes:
            _edit(trial, action, place - position, terminal)
            shift += {"drop": -1, "put": 1, "swap": 0}[action]
        items = following[position - 1] if position else [(self.net.start[self.net.root], 0)]
        lists = waiting[:position]
        moved = _Shifted(trial, position)
        for i in range(position, position + len(trial.kinds)):
            _, ahead, done = self._step(moved, i, items, lists)
            if trial.kinds[i - position] == ("EOF",):
                return -1 if done else i - shift
            if not ahead:
                return i - shift
            if i - shift > goal:
                return i - shift
            items = ahead
        return position + len(trial.kinds) - shift

    def _least(self) -> list[float]:
        """Fewest tokens from each state to the end of its rule."""
        least = getattr(self, "_least_held", None)
        if least is None:
            net = self.net
            least = [0.0 if a else float("inf") for a in net.accepts]
            changed = True
            while changed:
                changed = False
                for state in range(len(least)):
                    options = [1 + least[t] for s, t in net.terminal[state].items() if s != "NEVER"]
                    options += [least[net.start[r]] + least[t] for r, t in net.calls[state]]
                    options += [least[t] for _, t in net.guard[state]]
                    low = min(options, default=float("inf"))
                    if low < least[state]:
                        least[state] = low
                        changed = True
            self._least_held = least
        return least

    def _completion(self, tokens: Tokens, stop: int, waiting: list, following: list) -> int:
        """Fewest tokens to put in at ``stop`` so that the text before it is complete."""
        least = self._least()
        items = following[stop - 1] if stop else [(self.net.start[self.net.root], 0)]
        best: dict[tuple[int, int], float] = {}
        heap = [(0.0, i, item) for i, item in enumerate(items)]
        heapq.heapify(heap)
        count = len(heap)
        while heap:
            cost, _, item = heapq.heappop(heap)
            if item in best:
                continue
            best[item] = cost
            state, origin = item
            if state == -1:
                break
            rule = self.net.rule_of[state]
            total = cost + least[state]
            if rule == self.net.root and origin == 0:
                heapq.heappush(heap, (total, -1, (-1, 0)))
            for caller in waiting[origin].get(rule, ()) if origin < len(waiting) else ():
                if caller not in best:
                    count += 1
                    heapq.heappush(heap, (total, count, caller))
        return max(1, int(best.get((-1, 0), 1)))


@dataclass
class Repair:
    """``complete``: whether the repaired text parses."""

    cost: int
    edits: list[Edit]
    complete: bool


class _Shifted:
    """A window of tokens addressed by positions of the whole text."""

    def __init__(self, window: Tokens, start: int):
        self.kinds = _From(window.kinds, start)
        self.breaks = _From(window.breaks, start)


class _From:
    def __init__(self, rows: list, start: int):
        self.rows, self.start = rows, start

    def __getitem__(self, i: int):
        return self.rows[i - self.start]


def _edit(tokens: Tokens, action: str, place: int, terminal: str) -> None:
    if place >= len(tokens.kinds):
        return
    if action == "drop":
        for column in (tokens.kinds, tokens.lines, tokens.breaks):
            del column[place]
    elif action == "swap":
        tokens.kinds[place] = (terminal,)
    else:
        tokens.kinds.insert(place, (terminal,))
        tokens.lines.insert(place, tokens.lines[min(place, len(tokens.lines) - 1)])
        tokens.breaks.insert(place, False)
