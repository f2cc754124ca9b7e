"""YAML reader: indentation and simple keys become block tokens."""

from __future__ import annotations

import re

from lumenveil.llm.syntax.chart import Tokens

_PRINTABLE = re.compile(r"[^\t\n\r\x20-\x7e\x85\xa0-퟿-�\U00010000-\U0010ffff]")
_ANCHOR = re.compile(r"[^\s\[\]{},]+")
_TAG = re.compile(r"!(?:<[^>\s]+>|[^\s,\[\]{}]*)")
_ESCAPES = re.compile(r"\\(?:[0abtn\tvfre \"/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")


class _Broken(Exception):
    """The text is no YAML from here on."""


class _BlockReader:
    def __init__(self, text: str):
        self.text = text
        self.n = len(text)
        self.at = 0
        self.line = 0
        self.line_start = 0
        self.out: list[tuple[str, int]] = []
        self.indents = [-1]
        self.flow: list[str] = []
        self.key_allowed = True
        # possible simple key per flow level: (token index, line, offset, column, required)
        self.keys: dict[int, tuple[int, int, int, int, bool]] = {}

    @property
    def column(self) -> int:
        return self.at - self.line_start

    def emit(self, kind: str) -> None:
        self.out.append((kind, self.line))

    def peek(self, k: int = 0) -> str:
        p = self.at + k
        return self.text[p] if p < self.n else ""

    def blank(self, k: int = 0) -> bool:
        c = self.peek(k)
        return c == "" or c in " \t\n"

    def newline(self) -> None:
        self.at += 1
        self.line += 1
        self.line_start = self.at

    # -------------------------------------------------------- blanks and indentation

    def skip_blank(self) -> None:
        while True:
            while self.peek() == " " or (self.peek() == "\t" and (self.flow or not self.key_allowed or self._tab_is_blank())):
                self.at += 1
            if self.peek() == "#" and (self.at == 0 or self.text[self.at - 1] in " \t\n"):
                while self.at < self.n and self.text[self.at] != "\n":
                    self.at += 1
            if self.peek() != "\n":
                return
            self.newline()
            if not self.flow:
                self.key_allowed = True

    def _tab_is_blank(self) -> bool:
        """A tab before the end of the line or a comment separates nothing."""
        end = self.text.find("\n", self.at)
        rest = self.text[self.at : self.n if end < 0 else end].strip(" \t")
        return rest == "" or rest.startswith("#")

    def unwind(self, column: int) -> None:
        if self.flow:
            return
        while self.indents[-1] > column:
            self.indents.pop()
            self.emit("BLOCK_END")

    def indent(self, column: int) -> bool:
        if column > self.indents[-1]:
            self.indents.append(column)
            return True
        return False

    # -------------------------------------------------------- simple keys

    def stale(self) -> None:
        for level, (_, line, offset, _c, required) in list(self.keys.items()):
            if line != self.line or self.at - offset > 1024:
                if required:
                    raise _Broken
                del self.keys[level]

    def save_key(self) -> None:
        required = not self.flow and self.indents[-1] == self.column
        if self.key_allowed:
            self.drop_key()
            self.keys[len(self.flow)] = (len(self.out), self.line, self.at, self.column, required)

    def drop_key(self) -> None:
        key = self.keys.pop(len(self.flow), None)
        if key is not None and key[4]:
            raise _Broken

    # -------------------------------------------------------- tokens

    def run(self) -> list[tuple[str, int]]:
        if (m := _PRINTABLE.search(self.text)) is not None:
            self.line = self.text.count("\n", 0, m.start())
            self.emit("BAD")
            return self.out
        try:
            while self.one():
                pass
        except _Broken:
            self.emit("BAD")
        return self.out

    def one(self) -> bool:
        self.skip_blank()
        self.stale()
        self.unwind(self.column)
        c = self.peek()
        if c == "":
            self.unwind(-1)
            self.drop_key()
            return False
        column = self.column
        if column == 0 and c == "%":
            self.unwind(-1)
            self.drop_key()
            self.key_allowed = False
            self.emit("DIRECTIVE")
            while self.at < self.n and self.text[self.at] != "\n":
                self.at += 1
            return True
        if column == 0 and self.text.startswith(("---", "..."), self.at) and self.blank(3):
            self.unwind(-1)
            self.drop_key()
            if self.flow:
                raise _Broken
            self.key_allowed = False
            self.emit("DOC_START" if c == "-" else "DOC_END")
            self.at += 3
            if c == ".":
                self.rest_is_blank()
            return True
        if c in "[{":
            self.save_key()
            self.flow.append(c)
            self.key_allowed = True
            self.emit(c)
            self.at += 1
        elif c in "]}":
            self.drop_key()
            if not self.flow:
                raise _Broken
            self.flow.pop()
            self.key_allowed = False
            self.emit(c)
            self.at += 1
        elif c == ",":
            if not self.flow:
                raise _Broken
            self.key_allowed = True
            self.drop_key()
            self.emit(",")
            self.at += 1
        elif c == "-" and self.blank(1):
            if self.flow:
                raise _Broken
            if not self.key_allowed:
                raise _Broken
            if self.indent(column):
                self.emit("SEQ_START")
            self.key_allowed = True
            self.drop_key()
            self.emit("ENTRY")
            self.at += 1
        elif c == "?" and (self.blank(1) or (self.flow and False)):
            if not self.flow:
                if not self.key_allowed:
                    raise _Broken
                if self.indent(column):
                    self.emit("MAP_START")
            self.key_allowed = not self.flow
            self.drop_key()
            self.emit("KEY")
            self.at += 1
        elif c == ":" and (self.blank(1) or (self.flow and (self.peek(1) in ",[]{}" or self._json_key()))):
            self.value()
        elif c in "*&":
            self.save_key()
            self.key_allowed = False
            m = _ANCHOR.match(self.text, self.at + 1)
            if m is None:
                raise _Broken
            self.emit("ALIAS" if c == "*" else "ANCHOR")
            self.at = m.end()
        elif c == "!":
            self.save_key()
            self.key_allowed = False
            m = _TAG.match(self.text, self.at)
            self.emit("TAG")
            self.at = m.end()
            if not (self.blank() or (self.flow and self.peek() in ",[]{}")):
                raise _Broken
        elif c in "|>" and not self.flow:
            self.key_allowed = True
            self.drop_key()
            self.emit("SCALAR")
            self.block_scalar()
        elif c in "\"'":
            self.save_key()
            self.key_allowed = False
            self.emit("SCALAR")
            self.quoted(c)
        elif c not in ",[]{}#&*!|>'\"%@`" and (c not in "-?:" or (not self.blank(1) and (not self.flow or self.peek(1) not in ",[]{}"))):
            self.save_key()
            self.key_allowed = False
            self.emit("SCALAR")
            self.plain()
        else:
            raise _Broken
        return True

    def _json_key(self) -> bool:
        """A colon right after a quoted or bracketed key of a flow mapping."""
        return self.at > 0 and self.text[self.at - 1] in "\"'}]"

    def value(self) -> None:
        key = self.keys.pop(len(self.flow), None)
        if key is not None:
            index, line, _offset, column, _required = key
            self.out.insert(index, ("KEY", line))
            for level, other in list(self.keys.items()):
                if other[0] >= index:
                    self.keys[level] = (other[0] + 1, *other[1:])
            if not self.flow and self.indent(column):
                self.out.insert(index, ("MAP_START", line))
            self.key_allowed = False
        else:
            if not self.flow:
                if not self.key_allowed:
                    raise _Broken
                if self.indent(self.column):
                    self.emit("MAP_START")
            self.key_allowed = not self.flow
            self.drop_key()
        self.emit("VALUE")
        self.at += 1

    def rest_is_blank(self) -> None:
        end = self.text.find("\n", self.at)
        rest = self.text[self.at : self.n if end < 0 else end].strip(" \t")
        if rest and not rest.startswith("#"):
            raise _Broken

    def block_scalar(self) -> None:
        self.at += 1
        explicit = 0
        while self.peek() and self.peek() in "+-123456789":
            if self.peek().isdigit():
                explicit = int(self.peek())
            self.at += 1
        if not self.blank():
            raise _Broken
        self.rest_is_blank()
        while self.at < self.n and self.text[self.at] != "\n":
            self.at += 1
        parent = max(self.indents[-1], 0) if self.indents[-1] >= 0 else 0
        least = (parent + explicit) if explicit else None
        floor = self.indents[-1] + 1 if self.indents[-1] >= 0 else 0
        while self.at < self.n:
            start = self.at + 1
            end = self.text.find("\n", start)
            end = self.n if end < 0 else end
            row = self.text[start:end]
            lead = len(row) - len(row.lstrip(" "))
            if lead == len(row):
                if end >= self.n and start >= self.n:
                    self.at = self.n
                    return
                self.newline()
                self.at = end
                continue
            if least is None:
                if lead < max(floor, 1 if self.indents[-1] >= 0 else 0):
                    return
                least = lead
            if lead < least or (lead == 0 and self.text.startswith(("---", "..."), start) and (start + 3 >= self.n or self.text[start + 3] in " \t\n")):
                return
            self.newline()
            self.at = end
        return

    def quoted(self, quote: str) -> None:
        self.at += 1
        while True:
            c = self.peek()
            if c == "":
                raise _Broken
            if c == "\n":
                self.newline()
                if self.text.startswith(("---", "..."), self.at) and self.blank(3):
                    raise _Broken
            elif c == quote:
                if quote == "'" and self.peek(1) == "'":
                    self.at += 2
                    continue
                self.at += 1
                return
            elif c == "\\" and quote == '"':
                m = _ESCAPES.match(self.text, self.at)
                if m is None:
                    raise _Broken
                if self.peek(1) == "\n":
                    self.at += 1
                    self.newline()
                else:
                    self.at = m.end()
            else:
                self.at += 1

    def plain(self) -> None:
        """A plain scalar, over several lines while they are indented enough."""
        least = self.indents[-1] + 1
        text = self.text
        while True:
            start = self.at
            if self.peek() == "#" and start > 0 and text[start - 1] in " \t\n":
                return
            while self.at < self.n:
                c = text[self.at]
                if c in " \t\n":
                    break
                if c == ":" and (self.blank(1) or (self.flow and self.peek(1) in ",[]{}")):
                    break
                if self.flow and c in ",[]{}":
                    break
                self.at += 1
            if self.at == start:
                return
            self.key_allowed = False
            end, line, line_start = self.at, self.line, self.line_start
            broke = False
            while self.peek() and self.peek() in " \t\n":
                if self.peek() == "\n":
                    self.newline()
                    broke = True
                    if self.text.startswith(("---", "..."), self.at) and self.blank(3):
                        self.at, self.line, self.line_start = end, line, line_start
                        return
                elif self.peek() == "\t" and broke and not self.flow and self.column < least:
                    break
                else:
                    self.at += 1
            if self.peek() == "" or self.peek() == "#" or (broke and not self.flow and self.column < least):
                self.at, self.line, self.line_start = end, line, line_start
                return
            if broke:
                self.key_allowed = True


def yaml(text: str) -> Tokens:
    if text.startswith("﻿"):
        text = text[1:]
    out = Tokens()
    reader = _BlockReader(text.replace("\r\n", "\n").replace("\r", "\n"))
    for kind, line in reader.run():
        out.add((kind,), line + 1)
    out.add(("EOF",), reader.line + 1, True)
    return out
