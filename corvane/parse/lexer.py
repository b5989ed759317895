"""Tolerant lexers: source text to a tree of tokens and bracket groups.

Never raises on broken input: an unclosed string ends with its line, an unclosed bracket with the
file (or, in Python, before the next line that begins a definition), and a stray closing bracket is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass


@dataclass(slots=True)
class Tok:
    """``kind``: id, num, str, op or nl; ``parts`` holds the expressions inside an interpolated string."""

    kind: str
    text: str
    start: int
    end: int
    parts: list | tuple = ()


@dataclass
class Group:
    """A bracketed list of items; ``kind`` is its opening bracket."""

    kind: str
    items: list
    start: int
    end: int

    text = ""


CLOSING = {"(": ")", "[": "]", "{": "}"}

_OPS = {
    "python": ["**=", "//=", ">>=", "<<=", "...", "->", ":=", "==", "!=", "<=", ">=", "**", "//", "<<", ">>", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@="],
    "ts": [">>>=", "...", "===", "!==", "**=", "<<=", ">>=", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**"],
    "rust": ["..=", "<<=", ">>=", "...", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "..", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="],
}
_ID = re.compile(r"[^\W\d][\w$]*|[$_][\w$]*")
_NUM = re.compile(r"\.?\d(?:[eE][+-]?\d|[\w.])*")
BLANKS = " \t\r\f\v\u00a0\ufeff"
_PLAIN = {lang: re.compile(f"(?P<blank>[{BLANKS}]+)|(?P<nl>\\n)|(?P<id>{_ID.pattern})|(?P<num>{_NUM.pattern})|(?P<op>{'|'.join(map(re.escape, ops))}|.)", re.S) for lang, ops in _OPS.items()}
#: Characters at which something else than a plain token may begin.
_SPECIAL = {"python": frozenset("#\\'\"rRbBuUfFtT"), "ts": frozenset("/'\"`#"), "rust": frozenset("/\"'rbc")}
#: What may end a string or stand for itself in it, by its quote and whether it is raw and goes over lines.
_STOP = {(q, raw, lines): re.compile(f"[{q}{'' if raw else chr(92) * 2}{'' if lines else chr(10)}]") for q in "'\"`" for raw in (False, True) for lines in (False, True)}
_PY_STRING = re.compile(r"([rRbBuUfFtT]{0,3})('''|\"\"\"|'|\")")
_RUST_RAW = re.compile(r'(?:b|c)?r(#*)"')
_RUST_CHAR = re.compile(r"b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])'")
_BEFORE_REGEX = frozenset("( [ { , ; = : ! & | ? + - * % ^ ~ < > => == === != !== && || ?? += -= return typeof case in of delete void throw new else do".split())


class Source:
    """Text with positions: offsets in characters, lines from 0, columns in UTF-8 bytes."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.plain = text.isascii()

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset) - 1
        col = offset - self.starts[line]
        if not self.plain:
            col = len(self.text[self.starts[line] : offset].encode("utf-8", "surrogatepass"))
        return line, col

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1


class Lexer:
    def __init__(self, text: str, lang: str, start: int = 0, end: int | None = None):
        self.text, self.lang, self.i = text, lang, start
        self.end = len(text) if end is None else end
        self.out: list[Tok] = []

    def run(self) -> list[Tok]:
        """All tokens; comments and blanks are left out, ends of lines are tokens."""
        step = {"python": self._python, "ts": self._ts, "rust": self._rust}[self.lang]
        special, match, text, end, out = _SPECIAL[self.lang], _PLAIN[self.lang].match, self.text, self.end, self.out
        i = self.i
        while i < end:
            c = text[i]
            if c in special:
                self.i = i
                if step(c):
                    i = self.i
                    continue
            m = match(text, i, end)
            stop = m.end()
            if (kind := m.lastgroup) != "blank":
                out.append(Tok(kind, m[0], i, stop))
            i = stop
        self.i = i
        return out

    def logical(self) -> list[Tok]:
        """Python's tokens up to the first end of a line outside brackets, which comes last if there is one.

        Open brackets also end before a line that begins with a definition's keyword, as in ``nested``.
        """
        match, text, end, out, open_, fresh = _PLAIN["python"].match, self.text, self.end, self.out, [], True
        special = _SPECIAL["python"]
        while self.i < end:
            c, had = text[self.i], len(out)
            if c in special and self._python(c):
                fresh = fresh and len(out) == had
                continue
            m = match(text, self.i, end)
            kind, said = m.lastgroup, m[0]
            if kind == "blank":
                self.i = m.end()
                continue
            if open_ and fresh and (kind == "id" and said in _BEGINS or said == "@"):
                out.append(Tok("nl", "\n", self.i, self.i))
                break
            out.append(Tok(kind, said, self.i, m.end()))
            self.i = m.end()
            fresh = kind == "nl"
            if fresh and not open_:
                break
            if kind == "op":
                _bracket(open_, said)
        return out

    def _put(self, kind: str, end: int, parts: list | None = None) -> None:
        end = min(end, self.end)
        self.out.append(Tok(kind, self.text[self.i : end], self.i, end, parts or []))
        self.i = end

    def _line_end(self) -> int:
        k = self.text.find("\n", self.i, self.end)
        return self.end if k < 0 else k

    def _quoted(self, at: int, quote: str, raw: bool = False, multiline: bool = False) -> int:
        """End of a string whose content begins at ``at``."""
        search = _STOP[quote[0], raw, multiline].search
        while at < self.end and (found := search(self.text, at, self.end)):
            at = found.start()
            if self.text[at] == "\\" and not raw:
                at += 2
            elif self.text.startswith(quote, at):
                return at + len(quote)
            elif self.text[at] == "\n" and not multiline:
                return at
            else:
                at += 1
        return self.end

    def _inner(self, at: int) -> tuple[list, int]:
        """Items of an interpolation that begins at ``at``, and the place of its closing brace."""
        depth, k = 0, at
        while k < self.end:
            c = self.text[k]
            if c in "'\"`":
                k = self._quoted(k + 1, c, multiline=c == "`")
                continue
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if not depth:
                    break
                depth -= 1
            k += 1
        return nested(Lexer(self.text, self.lang, at, k).run()), k

    def _python(self, c: str) -> bool:
        t = self.text
        if c == "#":
            self.i = self._line_end()
            return True
        if c == "\\" and t.startswith("\n", self.i + 1):
            self.i += 2
            return True
        if m := _PY_STRING.match(t, self.i, self.end):
            prefix, quote = m[1].lower(), m[2]
            end = self._quoted(m.end(), quote, multiline=len(quote) == 3)
            parts = []
            if "f" in prefix or "t" in prefix:
                k = m.end()
                while k < end:
                    if t.startswith("{{", k):
                        k += 2
                    elif t[k] == "{":
                        items, k = self._inner(k + 1)
                        parts.append(items)
                        end = max(end, min(k + 1, self.end))
                    else:
                        k += 1
            self._put("str", end, parts)
            return True
        return False

    def _slash(self, nests: bool) -> bool:
        t = self.text
        if t.startswith("//", self.i):
            self.i = self._line_end()
            return True
        if t.startswith("/*", self.i):
            depth, k = 1, self.i + 2
            while k < self.end and depth:
                if t.startswith("*/", k):
                    depth, k = depth - 1, k + 2
                elif nests and t.startswith("/*", k):
                    depth, k = depth + 1, k + 2
                else:
                    k += 1
            if "\n" in t[self.i : k]:
                self.out.append(Tok("nl", "\n", k, k))
            self.i = k
            return True
        return False

    def _ts(self, c: str) -> bool:
        t = self.text
        if c == "/":
            if self._slash(False):
                return True
            last = next((x for x in reversed(self.out) if x.kind != "nl"), None)
            if last is None or last.text in _BEFORE_REGEX:
                k, inside = self.i + 1, False
                while k < self.end and t[k] != "\n" and (inside or t[k] != "/"):
                    inside = (inside or t[k] == "[") and t[k] != "]"
                    k += 2 if t[k] == "\\" else 1
                if k < self.end and t[k] == "/":
                    self._put("str", _ID.match(t, k + 1).end() if _ID.match(t, k + 1) else k + 1)
                    return True
            return False
        if c in "'\"":
            self._put("str", self._quoted(self.i + 1, c))
            return True
        if c == "`":
            k, parts = self.i + 1, []
            while k < self.end and t[k] != "`":
                if t[k] == "\\":
                    k += 2
                elif t.startswith("${", k):
                    items, k = self._inner(k + 2)
                    parts.append(items)
                    k += 1
                else:
                    k += 1
            self._put("str", k + 1, parts)
            return True
        if c == "#" and _ID.match(t, self.i + 1):
            self._put("id", _ID.match(t, self.i + 1).end())
            return True
        return False

    def _rust(self, c: str) -> bool:
        t = self.text
        if c == "/" and self._slash(True):
            return True
        if m := _RUST_RAW.match(t, self.i, self.end):
            k = t.find('"' + m[1], m.end(), self.end)
            self._put("str", self.end if k < 0 else k + 1 + len(m[1]))
            return True
        if c == '"' or t.startswith(('b"', 'c"'), self.i):
            self._put("str", self._quoted(self.i + 1 + (c != '"'), '"', multiline=True))
            return True
        if m := _RUST_CHAR.match(t, self.i, self.end):
            self._put("str", m.end())
            return True
        if c == "'":
            m = _ID.match(t, self.i + 1, self.end)
            self._put("life", m.end() if m else self.i + 1)
            return True
        if t.startswith("r#", self.i) and (m := _ID.match(t, self.i + 2, self.end)):
            self._put("id", m.end())
            return True
        return False


#: Words that no line within brackets begins with.
_BEGINS = ("def", "class", "import")


def _bracket(open_: list[str], text: str) -> None:
    """Keeps the closing brackets that are awaited, as ``nested`` takes them."""
    if text in CLOSING:
        open_.append(CLOSING[text])
    elif text in open_:
        while open_.pop() != text:
            pass


def opens(tokens: list[Tok]) -> bool:
    """Whether a bracket is still open after the tokens."""
    open_: list[str] = []
    for t in tokens:
        if t.kind == "op":
            _bracket(open_, t.text)
    return bool(open_)


def nested(tokens: list[Tok], keep_lines: bool = False, recover: bool = False) -> list:
    """Tokens as a tree.  Ends of lines are kept at the top only (``keep_lines``) or nowhere.

    ``recover``: an open bracket ends before a line that begins with a definition's keyword, which no Python expression can.
    """
    top: list = []
    stack: list[Group] = []
    items = top
    fresh = True
    for t in tokens:
        if recover and stack and fresh and t.kind == "id" and t.text in _BEGINS or recover and stack and fresh and t.text == "@":
            for g in stack:
                g.end = t.start
            stack.clear()
            items = top
            if keep_lines:
                top.append(Tok("nl", "\n", t.start, t.start))
        if t.kind == "nl":
            fresh = True
            if keep_lines and not stack:
                items.append(t)
            continue
        fresh = False
        if t.kind == "op" and t.text in CLOSING:
            g = Group(t.text, [], t.start, t.end)
            items.append(g)
            stack.append(g)
            items = g.items
        elif t.kind == "op" and t.text in ")]}":
            if any(CLOSING[g.kind] == t.text for g in stack):
                while stack:
                    g = stack.pop()
                    g.end = t.end if CLOSING[g.kind] == t.text else t.start
                    if CLOSING[g.kind] == t.text:
                        break
                items = stack[-1].items if stack else top
        else:
            items.append(t)
    last = tokens[-1].end if tokens else 0
    for g in stack:
        g.end = last
    return top


def split(items: list, *seps: str) -> list[list]:
    """Pieces of a list between operators of these texts, at this level."""
    out: list[list] = [[]]
    for x in items:
        if isinstance(x, Tok) and x.kind == "op" and x.text in seps:
            out.append([])
        else:
            out[-1].append(x)
    return out


def flat(items: list):
    """Every token in a tree, those of interpolations included, in order."""
    for x in items:
        if isinstance(x, Group):
            yield from flat(x.items)
        else:
            yield x
            for part in x.parts:
                yield from flat(part)
