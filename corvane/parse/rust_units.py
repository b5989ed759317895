"""Front end for Rust over a tree of brackets."""

from __future__ import annotations

from corvane.parse.braces import RUST, Scorer, angle_end, calls, is_group, is_op, is_word, statement_rows, statements
from corvane.parse.lexer import Group, Lexer, Source, Tok, nested, split
from corvane.parse.model import Parsed, function, in_stack_order, span

_BEFORE = frozenset("pub const async unsafe extern default".split())


def function_at(items: list, i: int) -> tuple[str, int, int, Group | None, int] | None:
    """``(name, start, end, body or none, index behind)`` of a function item whose ``fn`` stands at ``i``."""
    if not is_word(items[i], "fn") or i + 1 >= len(items) or not is_word(items[i + 1]):
        return None
    k = i + 2
    if k < len(items) and is_op(items[k], "<"):
        k = angle_end(items, k) or k
    while k < len(items) and not is_group(items[k], "("):
        k += 1
    k += 1
    while k < len(items) and not is_group(items[k], "{") and not is_op(items[k], ";"):
        k += 1
    start = i
    while start and (is_word(items[start - 1]) and items[start - 1].text in _BEFORE or is_group(items[start - 1], "(") and start > 1 and is_word(items[start - 2], "pub") or isinstance(items[start - 1], Tok) and items[start - 1].kind == "str"):
        start -= 1
    last = items[min(k, len(items) - 1)]
    return items[i + 1].text, items[start].start, last.end, last if is_group(last, "{") else None, k + 1


def closure_at(items: list, i: int) -> int | None:
    """Index behind a closure that begins at ``i``."""
    x = items[i]
    k = i + 1 if is_word(x, "move") else i
    if k >= len(items) or not is_op(items[k], "|", "||"):
        return None
    if k == i and i and not (is_op(items[i - 1]) and not is_op(items[i - 1], "?") or isinstance(items[i - 1], Tok) and items[i - 1].kind == "op" and items[i - 1].text != "?" or is_word(items[i - 1], "return", "in", "else", "move", "async")):
        return None
    if is_op(items[k], "|"):
        k = next((n for n in range(k + 1, len(items)) if is_op(items[n], "|")), len(items) - 1)
    k += 1
    if k < len(items) and is_op(items[k], "->"):
        k = next((n for n in range(k, len(items)) if is_group(items[n], "{")), len(items) - 1)
    if k < len(items) and is_group(items[k], "{"):
        return k + 1
    while k < len(items) and not is_op(items[k], ",", ";"):
        k += 1
    return max(k, i + 1)


def stop(items: list, i: int) -> int | None:
    """Index behind a function or closure at ``i``, for complexity."""
    f = function_at(items, i)
    return f[4] if f else closure_at(items, i)


def _own(items: list, i: int) -> int | None:
    """Index behind a nested function item, an attribute or a macro's body, for callees: none of them has calls of this body."""
    f = function_at(items, i)
    if f:
        return f[4]
    if is_op(items[i], "#") and i + 1 < len(items) and is_group(items[i + 1], "["):
        return i + 2
    if is_word(items[i]) and i + 2 < len(items) and is_op(items[i + 1], "!") and isinstance(items[i + 2], Group):
        return i + 3
    return None


def names(items: list) -> list[str]:
    """Identifiers used as values or functions: no fields, no types by their capital, no words of the language."""
    out = []
    for k, x in enumerate(items):
        if isinstance(x, Group):
            out += names(x.items)
        elif x.kind == "id":
            member = k and is_op(items[k - 1], ".")
            path = k + 1 < len(items) and is_op(items[k + 1], "::")
            typed = k and is_op(items[k - 1], ":") or k and is_word(items[k - 1], "as")
            if not member and not typed and not path and x.text not in RUST.keywords and x.text not in ("true", "false", "_"):
                out.append(x.text)
    return out


def flow(s: list) -> tuple[list[str], list[str]]:
    writes, reads = [], []
    for piece in split(s, ";"):
        if not piece:
            continue
        let = next((k for k, x in enumerate(piece) if is_word(x, "let")), None)
        at = next((k for k, x in enumerate(piece) if is_op(x, "=")), None)
        if let is not None and (let == 0 or is_op(piece[let - 1], "#")):
            pattern = split(piece[let + 1 : at if at is not None else len(piece)], ":")[0]
            writes += names(pattern)
            rest = piece[at + 1 :] if at is not None else []
        elif at is not None and let is None:
            writes += names(piece[:at])
            rest = piece[at + 1 :]
        else:
            rest = piece
        plain = []
        for x in rest:
            if is_group(x, "{") and any(is_word(y, "let") or is_op(y, "=", ";") for y in x.items):
                w, r = flow(x.items)
                writes += w
                reads += r
                plain.append(Tok("op", ",", x.start, x.end))
            else:
                plain.append(x)
        reads += names(plain)
    return writes, reads


def parse(text: str) -> Parsed:
    src = Source(text)
    out = Parsed()
    top = nested(Lexer(text, "rust").run())
    scorer = Scorer(src, RUST, stop)

    def walk(items: list, scope: list[str]) -> None:
        i = 0
        while i < len(items):
            x = items[i]
            f = function_at(items, i)
            if f:
                name, start, end, body, behind = f
                own: list[tuple[int, int, str]] = []
                cc = 0
                if body is not None:
                    calls(body.items, RUST, lambda s, e, a, b, g, own=own: own.append((s, e, text[a:b].strip())), _own)
                    cc = scorer.block(body.items, 0)
                    out.bodies.append({"name": "::".join([*scope, name]), "range": span(src, start, end), "statements": statement_rows(body, src, RUST, flow)})
                out.functions.append(function(src, "::".join([*scope, name]), start, end, cc, in_stack_order(own)))
                if body is not None:
                    walk(body.items, [*scope, name])
                i = behind
                continue
            if is_word(x, "impl", "trait", "mod") and i + 1 < len(items):
                b = next((k for k in range(i + 1, len(items)) if is_group(items[k], "{") or is_op(items[k], ";")), None)
                if b is not None and is_group(items[b], "{"):
                    walk(items[b].items, [*scope, _scope(text, items, i, b)])
                    i = b + 1
                    continue
            if isinstance(x, Group):
                walk(x.items, scope)
            i += 1

    walk(top, [])
    for s in statements(top, src, RUST):
        at = next((k for k, x in enumerate(s) if is_word(x, "use")), None)
        if at is not None and all(is_word(x, "pub") or is_group(x, "(") or is_op(x, "#") or is_group(x, "[") for x in s[:at]):
            first = next((x for x in s[at + 1 :] if is_word(x)), None)
            if first is None:
                group = next((x for x in s[at + 1 :] if is_group(x, "{")), None)
                first = next((x for x in reversed(group.items) if is_word(x)), None) if group else None
            start = next(x for x in s if is_word(x, "pub", "use")).start
            if first is not None:
                out.imports.append({"module": first.text.removeprefix("r#"), "range": span(src, start, s[-1].end)})
    return out


def _scope(text: str, items: list, i: int, b: int) -> str:
    """The type of an impl, or the name of a trait or module."""
    if not is_word(items[i], "impl"):
        return items[i + 1].text or "<anon>"
    k = i + 1
    if k < b and is_op(items[k], "<"):
        k = angle_end(items, k) or k
    where = next((n for n in range(k, b) if is_word(items[n], "where")), b)
    after = next((n for n in range(k, where) if is_word(items[n], "for") and not (n + 1 < b and is_op(items[n + 1], "<"))), None)
    first = k if after is None else after + 1
    return text[items[first].start : items[where - 1].end].strip() if first < where else "<impl>"
