"""Lexers: whole texts to tokens for the chart parser.

A text that no lexer rule covers gives the terminal ``BAD``, which no grammar contains, so lexical errors are repaired by the
parser like any other.
"""

from __future__ import annotations

import re

from lumenveil.llm.syntax.chart import Tokens

EOF = ("EOF",)
BAD = ("BAD",)


def clean(text: str) -> str:
    """Without byte order mark, with line feeds only."""
    if text.startswith("﻿"):
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n")


_STR = ("STR",)
_SIGN: dict[str, tuple[str, ...]] = {}


class _Lines:
    """Tokens of lines that no token can leave.  ``most`` lines of up to ``longest`` characters are remembered.

    ``spans`` matches lines whose tokens may go on in the next line; ``careful`` those that only ``lex`` reads rightly, as it does lines with
    stray characters.  ``pieces`` finds all tokens of the other lines at once: word, sign, string, number, stray character.
    """

    def __init__(self, spans: str, careful: str, pieces: str, kinds_of, number_kind, lex, most: int = 150_000, longest: int = 240):
        self._spans, self._careful, self._pieces = re.compile(spans).search, re.compile(careful).search, re.compile(pieces).findall
        self._kinds_of, self._number_kind, self._lex, self._most, self._longest = kinds_of, number_kind, lex, most, longest
        self.known: dict[str, tuple] = {}

    def learn(self, line: str) -> tuple | None:
        """Terminals of the line's tokens; None if one of them might go on in the next line."""
        if self._spans(line):
            return None
        kinds: list[tuple[str, ...]] | None = None
        if not self._careful(line):
            kinds, kinds_of = [], self._kinds_of
            for word, sign, string, number, stray in self._pieces(line):
                if word:
                    kinds.append(kinds_of(word))
                elif sign:
                    kinds.append(_SIGN.get(sign) or _SIGN.setdefault(sign, (sign,)))
                elif string:
                    kinds.append(_STR)
                elif number:
                    kind = self._number_kind(number)
                    if kind is BAD:
                        kinds = None
                        break
                    kinds.append(kind)
                elif stray:
                    kinds = None
                    break
        found = tuple(kinds) if kinds is not None else self._lex(line)
        if len(line) <= self._longest:
            if len(self.known) >= self._most:
                self.known.clear()
            self.known[line] = found
        return found


def _pieces(word: str, string: str, number: str, punct: str, comment: str) -> str:
    return rf"[^\S\n]*(?:(?:{comment})|({word})|((?!\.\d)(?:{punct}))|({string})|({number}[\w$]*)|(\S))"


# ---------------------------------------------------------------- brace languages

_JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
_JS_CONTEXT = frozenset(
    "async await of get set static as from let yield type interface declare namespace module abstract readonly private public protected override implements keyof infer is asserts satisfies unique constructor require global accessor using out".split()
)
_JAVA_RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
_JAVA_CONTEXT = frozenset("var record sealed permits non yield when module open opens exports requires".split())
_CS_RESERVED = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
_CS_CONTEXT = frozenset(
    "var dynamic async await get set init add remove value where when record partial yield global nameof and or not with required file scoped select from orderby group into join let on equals by ascending descending managed unmanaged notnull".split()
)
_GO_RESERVED = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)


_PLAIN_WORD = ("ID", "NAME")


def _word_kinds(reserved: frozenset[str], context: frozenset[str]):
    cache: dict[str, tuple[str, ...]] = {}

    def kinds(word: str) -> tuple[str, ...]:
        k = cache.get(word)
        if k is None:
            if word in reserved:
                k = (word, "NAME")
            elif word in context:
                k = (word, "ID", "NAME")
            else:
                return _PLAIN_WORD
            cache[word] = k
        return k

    return kinds


_WORD = r"[^\W\d][\w$]*"
_JS_WORD = r"(?:[^\W\d]|[$\\]|#(?=[^\W\d]))(?:[\w$‌‍]|\\u\{?[0-9a-fA-F]+\}?)*"
_NUMBER = r"0[xX][0-9a-fA-F_]+[nuUlL]*|0[bB][01_]+[nuUlL]*|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][-+]?\d[\d_]*)?[nfFdDmMlLuU]*"
_JS_PUNCT = r">|\.\.\.|=>|===|!==|==|!=|\*\*=|<<=|\*\*|<<|<=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-{}()\[\];,<+*/%&|^!~?:=.@]"
_JAVA_PUNCT = r">|\.\.\.|->|::|==|!=|<=|<<=|<<|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-{}()\[\];,<+*/%&|^!~?:=.@]"
_CS_PUNCT = r">|\?\?=|\?\?|\.\.|=>|->|::|==|!=|<=|<<=|<<|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-{}()\[\];,<+*/%&|^!~?:=.]"
_GO_PUNCT = r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-{}()\[\];,<>+*/%&|^!~:=.]"
#: Tokens after which a slash begins a regular expression, besides the start of the text.
_BEFORE_REGEX = frozenset(
    "( [ { } , ; : ? => = == === != !== < > <= + - * / % & | ^ ! ~ && || ?? += -= *= /= %= &= |= ^= <<= ** **= && ||= &&= ??= ... return typeof instanceof in of new delete void throw case do else yield await".split()
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JS_STRING = r"\"(?:[^\"\\\n]|\\(?:[^\n]|\n))*\"|'(?:[^'\\\n]|\\(?:[^\n]|\n))*'"
_SPACE = re.compile(r"[^\S\n]+")


_NL, _COMMENT, _STRING, _NUM, _WORD_AT, _PUNCT = range(1, 7)  # groups of a lexer pattern


def _pattern(word: str, string: str, punct: str, comment: str) -> re.Pattern:
    """Blanks, then one token; all inner groups must be non-capturing.  Blanks at the end match without a group."""
    return re.compile(rf"[^\S\n]*(?:(\n)|({comment})|({string})|(\.?\d(?:{_NUMBER_TAIL}))|({word})|({punct}))|[^\S\n]+\Z")


_NUMBER_TAIL = r"[xXbBoO]?[0-9a-fA-F_]*(?:\.(?!\.)[0-9_]*)?(?:(?<=[\d_.])[eEpP][-+]?\d[\d_]*|(?<=[eEpP])[-+]\d[\d_]*)?[nfFdDmMlLuUi]*"
_SLASH_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
_JS_TOKEN = _pattern(_JS_WORD, _JS_STRING, _JS_PUNCT, _SLASH_COMMENT)
_NUMBER_OK = re.compile(
    r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*(?:\.[0-9a-fA-F]*)?(?:[pP][-+]?\d+)?[nuUlL]*|0[bB][01](?:_?[01])*[nuUlL]*|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_*\d)*)?\.?(?:\d(?:_*\d)*)?(?:[eE][-+]?\d(?:_?\d)*)?[nfFdDmMlLuUi]*"
)


def _number(text: str) -> tuple[str, ...]:
    return ("NUM",) if _NUMBER_OK.fullmatch(text) and text != "." else BAD


_JS_KINDS = _word_kinds(_JS_RESERVED, _JS_CONTEXT)


def javascript(text: str) -> Tokens:
    """JavaScript and TypeScript; templates with substitutions become head, middle and tail tokens."""
    text = clean(text)
    if text.startswith("#!"):
        text = "//" + text[2:]
    return _javascript(text, _JS_LINES)[0]


def _javascript_line(line: str) -> tuple:
    return tuple(_javascript(line, None)[0].kinds[:-1])


#: Careful: names after dots, and slashes that neither start a comment nor stand in a string without other quotes before it.
_JS_LINES = _Lines(
    r"`|/\*|\\$|^\s*/(?!/)",
    rf"\.\s*(?:{'|'.join(sorted(_JS_RESERVED | _JS_CONTEXT))})\b|^(?:[^/'\"]|\"[^\"\\]*\"|'[^'\\]*')*/(?!/)",
    _pieces(_JS_WORD, _JS_STRING, rf"\.?\d(?:{_NUMBER_TAIL})", _JS_PUNCT, "//[^\n]*"),
    _JS_KINDS,
    _number,
    _javascript_line,
)


def _javascript(text: str, memory: _Lines | None) -> tuple[Tokens, str]:
    """(tokens, what stands last before a slash)."""
    kinds_of = _JS_KINDS
    out = Tokens()
    add_kind, add_line, add_break = out.kinds.append, out.lines.append, out.breaks.append
    at, line, broken, n = 0, 1, False, len(text)
    previous = "("
    nesting: list[str] = []  # '{' for braces, '`' for an open substitution
    match = _JS_TOKEN.match
    fresh = memory is not None
    while at < n:
        if fresh:
            fresh = False
            if "`" not in nesting and previous not in (".", "?."):
                end = text.find("\n", at)
                row = text[at : end if end >= 0 else n]
                learnt = memory.known.get(row) or memory.learn(row)
                if learnt is not None:
                    if learnt:
                        out.kinds += learnt
                        out.lines += [line] * len(learnt)
                        add_break(broken)
                        out.breaks += [False] * (len(learnt) - 1)
                        kind = learnt[-1]
                        previous = kind[0] if kind[0] not in _JS_CLOSING and (len(kind) == 1 or kind[0] in _JS_OPENING) else "x"
                    if end < 0:
                        break
                    at, line, broken, fresh = end + 1, line + 1, True, True
                    continue
        m = match(text, at)
        group = m.lastindex if m is not None else 0
        if group is None:
            break  # blanks at the end
        if group == 0 or group == _PUNCT:
            first = m.start(group) if group else _past_blanks(text, at)
            c = text[first]
            if c == "`" or (c == "}" and nesting and nesting[-1] == "`"):
                if c == "}":
                    nesting.pop()
                end, closed = _template(text, first + 1)
                kind = {("`", True): "TPL", ("`", False): "TPL_HEAD", ("}", True): "TPL_TAIL", ("}", False): "TPL_MIDDLE"}[c, closed] if end >= 0 else "BAD"
                out.add((kind,), line, broken)
                if end < 0:
                    end = n
                elif not closed:
                    nesting.append("`")
                line += text.count("\n", first, end)
                at, broken, previous = end, False, "x" if closed else "("
                continue
            if c == "/" and previous in _BEFORE_REGEX and (r := _JS_REGEX.match(text, first)):
                out.add(("REGEX",), line, broken)
                at, broken, previous = r.end(), False, "x"
                continue
            if group == 0:
                out.add(BAD, line, broken)
                at, broken, previous = first + 1, False, "x"
                continue
        at = m.end()
        if group == _NL:
            line += 1
            broken = True
            fresh = memory is not None
            continue
        piece = m.group(group)
        if group == _COMMENT:
            breaks = piece.count("\n")
            line += breaks
            broken = broken or breaks > 0
            continue
        if group == _WORD_AT:
            kind = kinds_of(piece)
            # a keyword after a dot is a name
            if previous == "." or previous == "?.":
                kind = _PLAIN_WORD
            previous = piece if kind is not _PLAIN_WORD and (piece in _JS_RESERVED or piece in ("of", "yield", "await")) else "x"
        elif group == _STRING:
            kind, previous = _STR, "x"
            if "\n" in piece:
                add_kind(kind)
                add_line(line)
                add_break(broken)
                broken = False
                line += piece.count("\n")
                continue
        elif group == _NUM:
            kind, previous = _number(piece), "x"
            if at < n and (text[at].isalnum() or text[at] in "_$"):
                kind = BAD
        else:
            kind = _SIGN.get(piece) or _SIGN.setdefault(piece, (piece,))
            previous = piece if piece not in (")", "]", "++", "--") else "x"
            if piece == "{":
                nesting.append("{")
            elif piece == "}" and nesting:
                nesting.pop()
        if kind is BAD:
            out.add(kind, line, broken)
        else:
            add_kind(kind)
            add_line(line)
            add_break(broken)
        broken = False
    out.add(EOF, line, True)
    return out, previous




_JS_CLOSING = frozenset((")", "]", "++", "--", "STR", "NUM", "BAD", "REGEX"))
_JS_OPENING = _JS_RESERVED | {"of", "yield", "await"}


def _past_blanks(text: str, at: int) -> int:
    m = _SPACE.match(text, at)
    return m.end() if m else at


def _template(text: str, at: int) -> tuple[int, bool]:
    """(end, whether the template closed there) of template text; end is -1 if it never ends."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1, True
        elif c == "$" and text.startswith("${", at):
            return at + 2, False
        else:
            at += 1
    return -1, False


def _plain(text: str, pattern: re.Pattern, kinds_of, memory: _Lines | None) -> Tokens:
    """Languages whose tokens need no context."""
    out = Tokens()
    add_kind, add_line, add_break = out.kinds.append, out.lines.append, out.breaks.append
    at, line, broken, n = 0, 1, False, len(text)
    match = pattern.match
    fresh = memory is not None
    while at < n:
        if fresh:
            fresh = False
            end = text.find("\n", at)
            row = text[at : end if end >= 0 else n]
            learnt = memory.known.get(row)
            if learnt is None:
                learnt = memory.learn(row)
            if learnt is not None:
                if learnt:
                    out.kinds += learnt
                    out.lines += [line] * len(learnt)
                    add_break(broken)
                    out.breaks += [False] * (len(learnt) - 1)
                if end < 0:
                    break
                at, line, broken, fresh = end + 1, line + 1, True, True
                continue
        m = match(text, at)
        if m is None:
            out.add(BAD, line, broken)
            at, broken = _past_blanks(text, at) + 1, False
            continue
        group = m.lastindex
        if group is None:
            break  # blanks at the end
        at = m.end()
        if group == _NL:
            line += 1
            broken = True
            fresh = memory is not None
            continue
        piece = m.group(group)
        if group == _COMMENT:
            line += piece.count("\n")
            continue
        if group == _WORD_AT:
            kind = kinds_of(piece.lstrip("@") if piece[0] == "@" else piece)
        elif group == _STRING:
            kind = _STR
        elif group == _NUM:
            kind = _number(piece)
            if at < n and (text[at].isalnum() or text[at] == "_"):
                kind = BAD
        else:
            kind = _SIGN.get(piece) or _SIGN.setdefault(piece, (piece,))
        if kind is BAD:
            out.add(kind, line, broken)
        else:
            add_kind(kind)
            add_line(line)
            add_break(broken)
        if group == _STRING and "\n" in piece:
            line += piece.count("\n")
        broken = False
    out.add(EOF, line, True)
    return out


_JAVA_STRING = r"\"\"\"[^\S\n]*\n(?s:(?:[^\\]|\\.)*?)\"\"\"|\"(?!\"\")(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[^\n])'"
_JAVA_TOKEN = _pattern(_WORD, _JAVA_STRING, _JAVA_PUNCT, _SLASH_COMMENT)
_JAVA_KINDS = _word_kinds(_JAVA_RESERVED, _JAVA_CONTEXT)


def java(text: str) -> Tokens:
    return _plain(clean(text), _JAVA_TOKEN, _JAVA_KINDS, _JAVA_LINES)


def _plain_lines(spans: str, careful: str, word: str, string: str, punct: str, kinds_of, pattern: re.Pattern) -> _Lines:
    return _Lines(
        spans, careful, _pieces(word, string, rf"\.?\d(?:{_NUMBER_TAIL})", punct, "//[^\n]*"), kinds_of, _number, lambda line: tuple(_plain(line, pattern, kinds_of, None).kinds[:-1])
    )


_JAVA_LINES = _plain_lines(r"/\*|\"\"\"", "(?!)", _WORD, _JAVA_STRING, _JAVA_PUNCT, _JAVA_KINDS, _JAVA_TOKEN)


_CS_HOLE = r"\{[^{}\"]*(?:\"(?:[^\"\\]|\\.)*\"[^{}\"]*)*\}"
_CS_STRING = (
    r"\$*\"\"\"(?s:.*?)\"\"\"|(?:\$@|@\$)\"(?s:(?:[^\"]|\"\")*)\"|@\"(?s:(?:[^\"]|\"\")*)\"|"
    rf"\$\"(?:[^\"\\\n{{}}]|\\[^\n]|\{{\{{|\}}\}}|{_CS_HOLE})*\"|"
    r"\"(?:[^\"\\\n]|\\[^\n])*\"(?:u8)?|'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{1,4}|\\[^\n])'"
)
_CS_TOKEN = _pattern(r"@?[^\W\d]\w*", _CS_STRING, _CS_PUNCT, _SLASH_COMMENT + r"|(?m:^[^\S\n]*\#[^\n]*)")
_CS_KINDS = _word_kinds(_CS_RESERVED, _CS_CONTEXT)


def csharp(text: str) -> Tokens:
    return _plain(clean(text), _CS_TOKEN, _CS_KINDS, _CS_LINES)


_CS_LINES = _plain_lines(r"/\*|\"\"\"|@\"|\$", "[@#]", r"[^\W\d]\w*", _CS_STRING, _CS_PUNCT, _CS_KINDS, _CS_TOKEN)


_GO_STRING = r"`[^`]*`|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|[^\n]))'"
_GO_TOKEN = _pattern(_WORD, _GO_STRING, _GO_PUNCT, _SLASH_COMMENT)
_GO_KINDS = _word_kinds(_GO_RESERVED, frozenset())
_GO_ENDS = frozenset("ID NUM STR break continue fallthrough return ++ -- ) ] }".split())


def go(text: str) -> Tokens:
    """Go; the semicolons that line ends stand for are put in."""
    raw = _plain(clean(text), _GO_TOKEN, _GO_KINDS, _GO_LINES)
    out = Tokens()
    last: tuple[str, ...] = ()
    for kinds, line, broken in zip(raw.kinds, raw.lines, raw.breaks):
        if broken and last and last[0] in _GO_ENDS:
            out.kinds.append(_SEMICOLON)
            out.lines.append(line)
            out.breaks.append(False)
        last = kinds
        out.kinds.append(kinds)
        out.lines.append(line)
        out.breaks.append(broken)
    return out


_SEMICOLON = (";",)
_GO_LINES = _plain_lines(r"/\*|`", "(?!)", _WORD, _GO_STRING, _GO_PUNCT, _GO_KINDS, _GO_TOKEN)


# ---------------------------------------------------------------- JSON

_JSON_TOKEN = re.compile(
    r"[ \t]*(?:(\n)|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])|(?:true|false|null)(?!\w))|([{}\[\],:]))|[ \t]+\Z"
)
_VALUE = ("VALUE",)


#: No token of JSON leaves its line.
_JSON_LINES = _Lines(
    "(?!)",
    "[^\\S \\t]",
    r"[ \t]*(?:((?:true|false|null)(?!\w))|([{}\[\],:])|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.]))|(\S))",
    lambda word: _VALUE,
    lambda number: _VALUE,
    lambda line: tuple(_json(line, None).kinds[:-1]),
)


def json(text: str) -> Tokens:
    return _json(clean(text), _JSON_LINES)


def _json(text: str, memory: _Lines | None) -> Tokens:
    out = Tokens()
    add_kind, add_line = out.kinds.append, out.lines.append
    at, line, n = 0, 1, len(text)
    fresh = memory is not None
    while at < n:
        if fresh:
            fresh = False
            end = text.find("\n", at)
            row = text[at : end if end >= 0 else n]
            learnt = memory.known.get(row)
            if learnt is None:
                learnt = memory.learn(row)
            if learnt is not None:
                out.kinds += learnt
                out.lines += [line] * len(learnt)
                if end < 0:
                    break
                at, line, fresh = end + 1, line + 1, True
                continue
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            while text[at] in " \t":
                at += 1
            if out.kinds and out.kinds[-1] is BAD and out.lines[-1] == line:
                at += 1
                continue
            add_kind(BAD)
            add_line(line)
            at += 1
            continue
        group = m.lastindex
        at = m.end()
        if group is None:
            break
        if group == 1:
            line += 1
            fresh = memory is not None
            continue
        if group == 2:
            add_kind(_STR)
        elif group == 3:
            add_kind(_VALUE)
        else:
            piece = m.group(4)
            add_kind(_SIGN.get(piece) or _SIGN.setdefault(piece, (piece,)))
        add_line(line)
    out.breaks = [False] * len(out.kinds)
    out.add(EOF, line, True)
    return out


# ---------------------------------------------------------------- Python

_PY_RESERVED = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PY_SOFT = frozenset("match case type print exec".split())
_PY_PREFIX = r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?"
_PY_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?"
_PY_PUNCT = r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:;.=]"
_PY_TOKEN = re.compile(
    rf"[ \t\f]*(?:(\n)|(\#[^\n]*)|(\\\n)|({_PY_PREFIX})(\"\"\"|'''|\"|')|([^\W\d]\w*)|((?=\.?\d)(?:{_PY_NUMBER}))|({_PY_PUNCT}))|[ \t\f]+\Z"
)
_PY_NL, _PY_COMMENT, _PY_JOINED, _PY_PREFIXED, _PY_QUOTE, _PY_WORDS, _PY_NUMBERS, _PY_SIGNS = range(1, 9)  # its groups
_NEWLINE, _PY_NUM = ("NEWLINE",), ("NUM",)
_PY_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*")


def _python_number(piece: str) -> tuple[str, ...]:
    return _PY_NUM if re.fullmatch(_PY_NUMBER, piece) and not _PY_ZERO.fullmatch(piece) else BAD


#: Careful: formatted strings.
_PY_LINES = _Lines(
    r"\"\"\"|'''|\\$|^[ \t\f]",
    r"(?i:\b[rbu]?[ft][rb]?)[\"']",
    _pieces(r"[^\W\d]\w*(?![\"'\w])", rf"{_PY_PREFIX}(?:\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\[^\n])*')", rf"(?=\.?\d)(?:{_PY_NUMBER})", _PY_PUNCT, r"\#[^\n]*"),
    _word_kinds(_PY_RESERVED, _PY_SOFT),
    _python_number,
    lambda line: tuple(k for k in _python(line, None).kinds[:-1] if k != _NEWLINE),
)
#: Per remembered line: brackets open at its end, most brackets closed that open before it.
_PY_DEPTHS: dict[tuple, tuple[int, int]] = {}


def _depths(kinds: tuple) -> tuple[int, int]:
    found = _PY_DEPTHS.get(kinds)
    if found is None:
        depth = lowest = 0
        for k in kinds:
            if k[0] in _PY_BRACKETS:
                depth += _PY_BRACKETS[k[0]]
                lowest = min(lowest, depth)
        if len(_PY_DEPTHS) >= 150_000:
            _PY_DEPTHS.clear()
        found = _PY_DEPTHS[kinds] = depth, lowest
    return found


_PY_BRACKETS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


def python(text: str) -> Tokens:
    """Python 3 with NEWLINE, INDENT and DEDENT; inconsistent indentation is BAD."""
    return _python(clean(text), _PY_LINES)


def _python(text: str, memory: _Lines | None) -> Tokens:
    out = Tokens()
    n, at, line = len(text), 0, 1
    columns = [(0, 0)]
    depth = 0
    fresh, start_of_row = True, False
    kinds_of = _PY_KINDS
    match = _PY_TOKEN.match
    add_kind, add_line, add_break = out.kinds.append, out.lines.append, out.breaks.append
    while at < n:
        if fresh and not depth:
            start = at
            while at < n and text[at] in " \t\f":
                at += 1
            if at < n and text[at] == "#":
                while at < n and text[at] != "\n":
                    at += 1
            if at >= n:
                break
            if text[at] == "\n":
                at, line = at + 1, line + 1
                continue
            if text[at] == "\\" and text.startswith("\\\n", at):
                fresh = False
                continue
            lead = text[start:at].rpartition("\f")[2]
            wide = narrow = len(lead)
            if "\t" in lead:
                wide = 0
                for c in lead:
                    wide = (wide // 8 + 1) * 8 if c == "\t" else wide + 1
            if wide > columns[-1][0]:
                out.add(("INDENT",) if narrow > columns[-1][1] else BAD, line)
                columns.append((wide, narrow))
            else:
                while wide < columns[-1][0]:
                    columns.pop()
                    out.add(("DEDENT",), line)
                if wide != columns[-1][0] or narrow != columns[-1][1]:
                    out.add(BAD, line)
            fresh = False
            start_of_row = True
        if start_of_row:
            start_of_row = False
            if memory is not None:
                while at < n and text[at] in " \t\f":
                    at += 1
                end = text.find("\n", at)
                row = text[at : end if end >= 0 else n]
                learnt = memory.known.get(row) or memory.learn(row)
                change, lowest = _depths(learnt) if learnt is not None else (0, -1 - depth)
                if depth + lowest >= 0:
                    if learnt and learnt[0] == BAD and out.kinds and out.kinds[-1] == BAD and out.lines[-1] == line:
                        learnt = learnt[1:]  # a run of stray characters is one token
                    out.kinds += learnt
                    out.lines += [line] * len(learnt)
                    out.breaks += [False] * len(learnt)
                    depth += change
                    if end < 0:
                        at = n
                        break
                    if depth:
                        start_of_row = True
                    else:
                        add_kind(_NEWLINE)
                        add_line(line)
                        add_break(False)
                        fresh = True
                    at, line = end + 1, line + 1
                    continue
        m = match(text, at)
        if m is None:
            while text[at] in " \t\f":
                at += 1
            out.add(BAD, line)
            at += 1
            continue
        group = m.lastindex
        if group is None:
            break  # blanks at the end
        if group == _PY_WORDS:
            add_kind(kinds_of(m.group(group)))
            add_line(line)
            add_break(False)
            at = m.end()
        elif group == _PY_SIGNS:
            piece = m.group(group)
            if piece in "([{":
                depth += 1
            elif depth and piece in ")]}":
                depth -= 1
            add_kind(_SIGN.get(piece) or _SIGN.setdefault(piece, (piece,)))
            add_line(line)
            add_break(False)
            at = m.end()
        elif group == _PY_NL:
            if not depth:
                add_kind(_NEWLINE)
                add_line(line)
                add_break(False)
                fresh = True
            else:
                start_of_row = True
            at, line = m.end(), line + 1
        elif group == _PY_COMMENT:
            at = m.end()
        elif group == _PY_JOINED:
            at, line = m.end(), line + 1
        elif group == _PY_QUOTE:
            quote, first, body = m.group(group), m.start(_PY_PREFIXED), m.end()
            prefix = text[first : m.start(group)].lower()
            end, holes = _py_string(text, body, quote, "f" in prefix or "t" in prefix)
            out.add(_STR if end > 0 and holes else BAD, line)
            if end < 0:
                # an open string ends with its line, a long one with the text
                stop = n if len(quote) == 3 else text.find("\n", first)
                line += text.count("\n", first, stop if stop >= 0 else n)
                at = n if stop < 0 else stop
            else:
                line += text.count("\n", first, end)
                at = end
        else:
            piece, at = m.group(group), m.end()
            bad = (at < n and (text[at].isalnum() or text[at] == "_") and not re.match(r"(?:and|else|for|if|in|is|or|not)\b", text[at : at + 5])) or _PY_ZERO.fullmatch(piece) is not None
            out.add(BAD if bad else _PY_NUM, line)
    if not fresh:
        out.add(("NEWLINE",), line)
    for _ in columns[1:]:
        out.add(("DEDENT",), line)
    out.add(EOF, line, True)
    return out


_PY_KINDS = _word_kinds(_PY_RESERVED, _PY_SOFT)


def _py_string(text: str, at: int, quote: str, formatted: bool) -> tuple[int, bool]:
    """(end of a string or -1, whether its replacement fields are closed)."""
    n, long = len(text), len(quote) == 3
    holes, open_ = 0, True
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if formatted and c == "{":
            if holes == 0 and text.startswith("{{", at):
                at += 2
                continue
            holes += 1
        elif formatted and c == "}":
            if holes == 0:
                if text.startswith("}}", at):
                    at += 2
                    continue
                return at + 1, False
            holes -= 1
        elif holes and c in "\"'" and not (not long and c == quote) and not text.startswith(quote, at):
            # a string inside a replacement field
            inner = text.find(c, at + 1)
            if inner > 0 and "\n" not in text[at:inner]:
                at = inner + 1
                continue
        elif c == "\n" and not long:
            return -1, open_
        elif text.startswith(quote, at):
            return at + len(quote), holes == 0
        at += 1
    return -1, open_
