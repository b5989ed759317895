"""What the front ends for languages with braces share: statements, calls and complexity over a token tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from corvane.parse.lexer import Group, Source, Tok, split
from corvane.parse.model import distinct, label, span


def is_op(x, *texts: str) -> bool:
    return isinstance(x, Tok) and x.kind == "op" and x.text in texts


def is_word(x, *texts: str) -> bool:
    return isinstance(x, Tok) and x.kind == "id" and (not texts or x.text in texts)


def is_group(x, kind: str) -> bool:
    return isinstance(x, Group) and x.kind == kind


@dataclass(frozen=True)
class Dialect:
    """Word lists of a language; ``arrow`` lets functions be expressions with ``=>``, ``macros`` hides what stands in a macro."""

    keywords: frozenset[str]
    values: frozenset[str]
    joins: tuple[str, ...]
    loops: frozenset[str]
    jumps: frozenset[str]
    arrow: bool
    macros: bool
    newline_ends: bool


TS = Dialect(
    frozenset("abstract as async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in instanceof interface keyof let namespace new of package private protected public readonly return satisfies set static switch throw try type typeof var void while with yield".split()),
    frozenset("this super import null true false undefined async get set of from type as static namespace declare abstract readonly package keyof satisfies".split()),
    (".", "?."),
    frozenset(("for", "while", "do")),
    frozenset(("break", "continue", "throw")),
    True,
    False,
    True,
)
RUST = Dialect(
    frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while".split()),
    frozenset("self Self super crate".split()),
    (".", "::"),
    frozenset(("for", "while", "loop")),
    frozenset(("break", "continue", "return")),
    False,
    True,
    False,
)


@dataclass
class Function:
    """A function found in a token tree: its name, where its declaration and body lie, and what kind of node it would be."""

    kind: str
    name: str | None
    start: int
    end: int
    params: Group | None
    body: Group | list | None
    inner_start: int = 0
    scope: tuple[str, ...] = field(default_factory=tuple)


def angle_end(items: list, i: int) -> int | None:
    """Index after the ``>`` that closes the ``<`` at ``i``, if what lies between looks like types."""
    depth = 0
    for k in range(i, len(items)):
        x = items[k]
        if is_op(x, "<"):
            depth += 1
        elif is_op(x, ">", ">>", ">>>"):
            depth -= len(x.text)
            if depth <= 0:
                return k + 1
        elif isinstance(x, Tok) and x.kind == "op" and x.text not in (",", ".", "|", "&", "::", "?", "=>", "->", "+", ":", "=", "*", "!", ";") or is_word(x, "if", "return", "const", "let", "for", "while"):
            return None
    return None


def operand(x, d: Dialect) -> bool:
    if isinstance(x, Group):
        return True
    return x.kind in ("str", "num") or x.kind == "id" and (x.text not in d.keywords or x.text in d.values)


def ends_expression(x, d: Dialect) -> bool:
    """Whether an expression may end after this item."""
    return isinstance(x, Group) or x.kind in ("str", "num", "life") or x.kind == "id" and (x.text not in d.keywords or x.text in d.values or x.text in ("break", "continue", "return")) or is_op(x, "++", "--", "?")


def starts_statement(x) -> bool:
    """Whether an item on a new line begins a statement, rather than going on with the last."""
    if isinstance(x, Group):
        return x.kind == "{"
    return x.kind in ("id", "str", "num") and x.text not in ("in", "of", "instanceof", "as", "satisfies", "else", "catch", "finally", "extends", "implements") or is_op(x, "@", "!", "++", "--", "...", "#")


def statements(items: list, src: Source, d: Dialect) -> list[list]:
    """Items of a block as statements, each with the clauses that belong to it."""
    out: list[list] = []
    cur: list = []
    heads = ("if", "for", "while", "do", "try", "switch", "function", "class", "interface", "enum", "namespace", "module") if d is TS else ("if", "for", "while", "loop", "match", "unsafe", "fn", "impl", "struct", "enum", "trait", "mod", "union", "extern")

    def flush() -> None:
        nonlocal cur
        if cur:
            out.append(cur)
        cur = []

    for k, x in enumerate(items):
        if cur and d.newline_ends and src.line(x.start) > src.line(cur[-1].end) and ends_expression(cur[-1], d) and starts_statement(x) and not _open_clause(cur, x, d):
            flush()
        cur.append(x)
        if is_op(x, ";"):
            if not (k + 1 < len(items) and is_word(items[k + 1], "else")):
                flush()
            continue
        if is_group(x, "{"):
            nxt = items[k + 1] if k + 1 < len(items) else None
            lead = next((y for y in cur if is_word(y) and y.text not in ("export", "default", "async", "pub", "const", "unsafe", "abstract", "declare") and not isinstance(y, Group)), None)
            first = next((y for y in cur if not (isinstance(y, Tok) and (y.kind == "life" or is_op(y, ":", "#")))), x)
            block = first is x or is_word(lead, *heads) and _leads(cur, lead)
            goes_on = is_word(nxt, "else", "catch", "finally") or is_word(first, "do") and is_word(nxt, "while")
            chained = d is RUST and is_op(nxt, ".", "?")
            if block and not goes_on and not chained and not (is_word(lead, "if", "for", "while", "switch") and not any(is_group(y, "(") for y in cur) and d is TS):
                flush()
    flush()
    return out


def _open_clause(cur: list, x, d: Dialect) -> bool:
    """Whether the last words want a statement that is still to come, as after ``if (x)`` at the end of a line."""
    if is_word(x, "else", "catch", "finally"):
        return True
    last = cur[-1]
    if is_word(last, "else", "do", "try", "finally"):
        return True
    return is_group(last, "(") and len(cur) > 1 and is_word(cur[-2], "if", "for", "while", "switch", "catch", "await")


def _leads(cur: list, lead) -> bool:
    """Whether the keyword begins the statement (after modifiers), rather than standing in an expression."""
    for y in cur:
        if y is lead:
            return True
        if not (isinstance(y, Tok) and (y.kind in ("id", "life") or is_op(y, "@", "#", ":")) or isinstance(y, Group) and y.kind in "([" ):
            return False
    return False


# --- calls ------------------------------------------------------------------------------------------------------------


def calls(items: list, d: Dialect, emit, stop=None) -> None:
    """``emit(start, end, callee start, callee end, arguments)`` for each call, at any depth.

    ``stop(items, i)`` may give an index to go on from, for stretches that are not to be looked at.
    """
    i = 0
    while i < len(items):
        if stop and (k := stop(items, i)) is not None:
            i = k
            continue
        x = items[i]
        if is_word(x, "new") and d is TS:
            k = i + 1
            while k < len(items) and (is_word(items[k]) or is_op(items[k], ".")):
                k += 1
            if k < len(items) and is_op(items[k], "<") and (e := angle_end(items, k)) is not None:
                k = e
            end = items[k - 1].end
            if k < len(items) and is_group(items[k], "("):
                calls(items[k].items, d, emit, stop)
                end, k = items[k].end, k + 1
            i = _trail(items, k, x.start, end, d, emit, stop)
            continue
        if isinstance(x, Tok):
            for part in x.parts:
                calls(part, d, emit, stop)
        elif not (d.macros and i and is_op(items[i - 1], "!") and i > 1 and is_word(items[i - 2])) and not (d.macros and i and is_op(items[i - 1], "#")):
            calls(x.items, d, emit, stop)
        if operand(x, d) and not is_group(x, "{"):
            i = _trail(items, i + 1, x.start, x.end, d, emit, stop)
        else:
            i += 1


def _trail(items: list, k: int, start: int, end: int, d: Dialect, emit, stop) -> int:
    """Goes on behind an operand: members, indices and calls."""
    while k < len(items):
        y = items[k]
        if is_op(y, *d.joins) and k + 1 < len(items) and isinstance(items[k + 1], Tok) and items[k + 1].kind in ("id", "num"):
            end, k = items[k + 1].end, k + 2
        elif is_op(y, "::") and k + 1 < len(items) and is_op(items[k + 1], "<") and (e := angle_end(items, k + 1)) is not None:
            end, k = items[e - 1].end, e
        elif d is TS and is_op(y, "<") and (e := angle_end(items, k)) is not None and e < len(items) and is_group(items[e], "("):
            calls(items[e].items, d, emit, stop)
            emit(start, items[e].end, start, end, items[e])
            end, k = items[e].end, e + 1
        elif is_op(y, "?.") and k + 1 < len(items) and isinstance(items[k + 1], Group):
            k += 1
        elif d is TS and is_op(y, "!") and k + 1 < len(items) and (is_op(items[k + 1], ".") or isinstance(items[k + 1], Group)):
            end, k = y.end, k + 1
        elif d is RUST and is_op(y, "?"):
            end, k = y.end, k + 1
        elif isinstance(y, Group) and y.kind in "([":
            if y.kind == "(" and d is TS and _arrow_follows(items, k):
                break
            calls(y.items, d, emit, stop)
            if y.kind == "(":
                emit(start, y.end, start, end, y)
            end, k = y.end, k + 1
        else:
            break
    return k


def _arrow_follows(items: list, k: int) -> bool:
    """Whether the group at ``k`` is the parameter list of an arrow function."""
    n = k + 1
    if n < len(items) and is_op(items[n], ":"):
        while n < len(items) and not is_op(items[n], "=>", ",", ";", "=", "{"):
            n += 1
    return n < len(items) and is_op(items[n], "=>")


def argc(group: Group) -> int:
    return len([p for p in split(group.items, ",") if p])


# --- complexity -------------------------------------------------------------------------------------------------------


class Scorer:
    """Cognitive complexity of a function's body."""

    def __init__(self, src: Source, d: Dialect, stop):
        self.src, self.d, self.stop = src, d, stop

    def block(self, items: list, nesting: int) -> int:
        return sum(self.statement(s, nesting) for s in statements(items, self.src, self.d))

    def statement(self, s: list, nesting: int) -> int:
        return self._run(s, 0, nesting)

    def _run(self, s: list, i: int, nesting: int) -> int:
        """Scores the items from ``i``: control words with their clauses, and the expressions between them."""
        total, plain = 0, []
        while i < len(s):
            x = s[i]
            if (k := self.stop(s, i)) is not None:
                i = k
                continue
            if is_word(x, "if"):
                add, i = self._if(s, i, nesting)
                total += add
            elif is_word(x, *self.d.loops) and not (self.d is RUST and is_word(x, "for") and i + 1 < len(s) and is_op(s[i + 1], "<")):
                add, i = self._loop(s, i, nesting)
                total += add
            elif self.d is TS and is_word(x, "try", "finally"):
                i += 1
                if i < len(s) and is_group(s[i], "{"):
                    total += self.block(s[i].items, nesting)
                    i += 1
            elif self.d is TS and is_word(x, "catch") and i + 1 < len(s) and isinstance(s[i + 1], Group):
                total += 1 + nesting
                i += 1 + is_group(s[i + 1], "(")
                if i < len(s) and is_group(s[i], "{"):
                    total += self.block(s[i].items, nesting + 1)
                    i += 1
            elif self.d is TS and is_word(x, "switch") and i + 1 < len(s) and is_group(s[i + 1], "("):
                total += 1 + nesting + self.expression(s[i + 1].items, nesting + 1)
                i += 2
                if i < len(s) and is_group(s[i], "{"):
                    total += self._cases(s[i].items, nesting + 1)
                    i += 1
            elif self.d is RUST and is_word(x, "match"):
                at = next((k for k in range(i + 1, len(s)) if is_group(s[k], "{")), len(s))
                total += 1 + nesting + self.expression(s[i + 1 : at], nesting + 1)
                if at < len(s):
                    total += self._arms(s[at].items, nesting + 1)
                i = at + 1
            elif is_word(x, *self.d.jumps):
                total += nesting > 0
                plain.append(Tok("op", ",", x.start, x.end))
                i += 1
            elif is_group(x, "{") and self._is_block(s, i):
                total += self.block(x.items, nesting)
                i += 1
            else:
                plain.append(x)
                i += 1
        return total + self.expression(plain, nesting)

    def _is_block(self, s: list, i: int) -> bool:
        if i == 0 or is_word(s[i - 1], "unsafe", "async", "move", "else", "do") or is_op(s[i - 1], "=>", ":", ";"):
            return self.d is RUST or i == 0
        return self.d is RUST and not is_word(s[i - 1]) and not is_op(s[i - 1], ">")

    def _if(self, s: list, i: int, nesting: int) -> tuple[int, int]:
        inner = nesting + 1
        total = 1 + nesting
        if self.d is TS:
            if i + 1 < len(s) and is_group(s[i + 1], "("):
                total += self.expression(s[i + 1].items, inner)
                i += 2
            else:
                i += 1
        else:
            at = next((k for k in range(i + 1, len(s)) if is_group(s[k], "{")), len(s))
            total += self.expression(s[i + 1 : at], inner)
            i = at
        add, i = self._branch(s, i, inner)
        total += add
        if i < len(s) and is_word(s[i], "else"):
            add, i = self._branch(s, i + 1, inner)
            total += 1 + add
        return total, i

    def _loop(self, s: list, i: int, nesting: int) -> tuple[int, int]:
        inner = nesting + 1
        total = 1 + nesting
        if is_word(s[i], "do"):
            add, i = self._branch(s, i + 1, inner)
            if i < len(s) and is_word(s[i], "while"):
                total += self.expression(s[i + 1].items, inner) if i + 1 < len(s) and isinstance(s[i + 1], Group) else 0
                i += 2
            return total + add, i
        at = next((k for k in range(i + 1, len(s)) if is_group(s[k], "(" if self.d is TS else "{")), len(s))
        if self.d is TS:
            total += sum(self.expression(p, inner) for p in split(s[at].items, ";")) if at < len(s) else 0
            at += 1
        else:
            total += self.expression(s[i + 1 : at], inner)
        add, at = self._branch(s, at, inner)
        return total + add, at

    def _branch(self, s: list, i: int, nesting: int) -> tuple[int, int]:
        """A block or a single statement."""
        if i < len(s) and is_group(s[i], "{"):
            return self.block(s[i].items, nesting), i + 1
        if i < len(s) and is_word(s[i], "if"):
            return self._if(s, i, nesting)
        if i < len(s) and self.d is TS and is_word(s[i], *self.d.loops):
            return self._loop(s, i, nesting)
        end = next((k for k in range(i, len(s)) if is_word(s[k], "else") or is_op(s[k], ";")), len(s))
        end += end < len(s) and is_op(s[end], ";")
        return self._run(s[i:end], 0, nesting), end

    def _cases(self, items: list, nesting: int) -> int:
        total, cur = 0, []
        for x in items:
            if is_word(x, "case", "default"):
                total += self.block(cur, nesting)
                cur = []
            elif is_op(x, ":") and not any(is_op(y, "?") for y in cur):
                total += self.expression(cur, nesting)
                cur = []
            else:
                cur.append(x)
        return total + self.block(cur, nesting)

    def _arms(self, items: list, nesting: int) -> int:
        """Each arm counts, and so does its pattern."""
        total, i = 0, 0
        while i < len(items):
            at = next((k for k in range(i, len(items)) if is_op(items[k], "=>")), None)
            if at is None:
                break
            guard = next((k for k in range(i, at) if is_word(items[k], "if")), at)
            total += 1 + nesting + 1 + nesting + 1 + self.expression(items[guard + 1 : at], nesting + 2)
            end = at + 1
            if end < len(items) and is_group(items[end], "{") and not (end + 1 < len(items) and is_op(items[end + 1], ".", "?")):
                total += self.block(items[end].items, nesting + 1)
                end += 1
            else:
                while end < len(items) and not is_op(items[end], ","):
                    end += 1
                total += self._run(items[at + 1 : end], 0, nesting + 1)
            i = end + (end < len(items) and is_op(items[end], ","))
        return total

    def expression(self, items: list, nesting: int) -> int:
        """Conditionals, and changes of the boolean operator within one bracket."""
        total, pieces, i = 0, [[]], 0
        while i < len(items):
            if (k := self.stop(items, i)) is not None:
                i = k
                continue
            x = items[i]
            if self.d is RUST and is_word(x, "if", "match", "for", "while", "loop", "return", "break", "continue", "unsafe"):
                total += self._run(items, i, nesting)
                break
            if self.d is TS and is_op(x, ":") and any(is_op(y, "?") for y in pieces[-1]):
                pieces[-1].append(x)
            elif is_op(x, ",", ";", "=", "=>", ":") or isinstance(x, Tok) and x.kind == "op" and x.text.endswith("=") and x.text not in ("==", "!=", "===", "!==", "<=", ">=", "..=") or is_word(x, "return", "of", "const", "let", "var", "yield", "await"):
                pieces.append([])
            else:
                pieces[-1].append(x)
            i += 1
        return total + sum(self._piece(p, nesting) for p in pieces)

    def _piece(self, items: list, nesting: int) -> int:
        if self.d is TS:
            at = next((k for k, x in enumerate(items) if is_op(x, "?")), None)
            if at is not None:
                depth, colon = 0, None
                for k in range(at + 1, len(items)):
                    depth += is_op(items[k], "?")
                    if is_op(items[k], ":"):
                        if not depth:
                            colon = k
                            break
                        depth -= 1
                if colon is not None:
                    inner = (items[:at], items[at + 1 : colon], items[colon + 1 :])
                    return 1 + nesting + sum(self._piece(p, nesting + 1) for p in inner)
        total = 0
        for k, x in enumerate(items):
            if isinstance(x, Group):
                if self.d.macros and k and is_op(items[k - 1], "!") and k > 1 and is_word(items[k - 2]):
                    continue
                blockish = self.d is RUST and x.kind == "{" and (k == 0 or not is_word(items[k - 1]))
                total += self.block(x.items, nesting) if blockish else self.expression(x.items, nesting)
            else:
                total += sum(self.expression(p, nesting) for p in x.parts)
        ands = [0]
        for x in items:
            if is_op(x, "||"):
                ands.append(0)
            elif is_op(x, "&&"):
                ands[-1] += 1
        return total + (len(ands) > 1) + sum(a > 0 for a in ands)


def statement_rows(body: Group, src: Source, d: Dialect, flow) -> list[dict]:
    """The statements of a body with their names written and read."""
    out = []
    for s in statements(body.items, src, d):
        if len(s) == 1 and is_op(s[0], ";"):
            continue
        writes, reads = flow(s)
        start, end = s[0].start, s[-1].end
        out.append({"range": span(src, start, end), "label": label(src.text[start:end]), "writes": distinct(writes), "reads": distinct(reads)})
    return out
