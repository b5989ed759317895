"""Front end for TypeScript and TSX over a tree of brackets."""

from __future__ import annotations

from corvane.parse.braces import TS, Function, Scorer, angle_end, argc, calls, is_group, is_op, is_word, statement_rows
from corvane.parse.lexer import Group, Lexer, Source, Tok, nested, split
from corvane.parse.model import Nodes, Parsed, arguments, function, in_stack_order, span

_NO_METHOD = frozenset("if for while switch catch with function return typeof new await throw super do else".split())
_MODIFIERS = frozenset("public private protected static async get set readonly abstract override declare accessor".split())
_BINDINGS = (".getUniformLocation", ".getAttribLocation", ".getProgramResourceIndex")


def _params_at(items: list, i: int) -> int | None:
    """Index of the parameter list that begins at ``i``, after type parameters."""
    if i < len(items) and is_op(items[i], "<"):
        e = angle_end(items, i)
        i = e if e is not None else len(items)
    return i if i < len(items) and is_group(items[i], "(") else None


def _body_at(items: list, i: int) -> int | None:
    """Index of the body after a parameter list's end at ``i``; a return type may stand between."""
    if i < len(items) and is_op(items[i], ":"):
        k = i + 1
        while k < len(items):
            if is_group(items[k], "{") and not is_op(items[k - 1], ":", "|", "&", "<", ",", "=>"):
                return k
            if is_op(items[k], ";", "=") or is_op(items[k], "=>"):
                return None
            k += 1
        return None
    return i if i < len(items) and is_group(items[i], "{") else None


def function_at(items: list, i: int) -> tuple[Function, int] | None:
    """A function node that begins at ``i``, and the index behind it."""
    x = items[i]
    k = i + 1 if is_word(x, "async") else i
    if k >= len(items):
        return None
    if is_word(items[k], "function") and not (i and is_op(items[i - 1], ".", "?.")):
        n = k + 1
        generator = n < len(items) and is_op(items[n], "*")
        n += generator
        name = items[n].text if n < len(items) and is_word(items[n]) else None
        p = _params_at(items, n + (name is not None))
        if p is None:
            return None
        b = _body_at(items, p + 1)
        if b is None:
            return None
        return Function("function", name, x.start, items[b].end, items[p], items[b]), b + 1
    p = _params_at(items, k)
    arrow, params = None, None
    if p is not None:
        n = p + 1
        if n < len(items) and is_op(items[n], ":"):
            n += 1
            while n < len(items) and not is_op(items[n], "=>", ",", ";", "=") and not (is_group(items[n], "{") and not is_op(items[n - 1], ":", "|", "&", "<", ",")):
                n += 1
        if n < len(items) and is_op(items[n], "=>"):
            arrow, params = n, items[p]
    elif is_word(items[k]) and k + 1 < len(items) and is_op(items[k + 1], "=>"):
        arrow = k + 1
    if arrow is None or i and is_op(items[i - 1], ".", "?."):
        return None
    n = arrow + 1
    if n < len(items) and is_group(items[n], "{"):
        return Function("arrow", None, x.start, items[n].end, params, items[n]), n + 1
    e = n
    while e < len(items) and not is_op(items[e], ",", ";"):
        if e > n and items[e - 1].end < items[e].start and is_word(items[e], "const", "let", "var", "function", "class", "export", "import", "return", "if", "for", "while"):
            break
        e += 1
    return Function("arrow", None, x.start, items[e - 1].end if e > n else items[arrow].end, params, items[n:e]), max(e, n)


def method_at(items: list, i: int) -> tuple[Function, int] | None:
    """``name(...) {...}`` with its modifiers, in a class or an object."""
    k = i
    while k < len(items) and (is_word(items[k]) and items[k].text in _MODIFIERS and k + 1 < len(items) and not is_group(items[k + 1], "(") and not is_op(items[k + 1], "=", ";", ":", ",") or is_op(items[k], "*")):
        k += 1
    if k >= len(items):
        return None
    x = items[k]
    named = isinstance(x, Tok) and x.kind in ("id", "str", "num") and not (x.kind == "id" and x.text in _NO_METHOD) or is_group(x, "[")
    if not named or i and (is_op(items[i - 1], ".", "?.", "=>", "=", ":") or is_word(items[i - 1], "function", "new", "class", "extends", "return")):
        return None
    p = _params_at(items, k + 1)
    b = _body_at(items, p + 1) if p is not None else None
    if b is None:
        return None
    return Function("method", x.text if isinstance(x, Tok) else "[computed]", items[i].start, items[b].end, items[p], items[b]), b + 1


def stop(items: list, i: int) -> int | None:
    """Index behind a function that begins at ``i``: what it holds belongs to it."""
    found = function_at(items, i) or method_at(items, i)
    return found[1] if found else None


def arity(params: Group | None) -> tuple[int, int | None] | None:
    if params is None:
        return None
    least = most = 0
    variadic = False
    for p in _typed_split(params.items):
        if is_op(p[0], "..."):
            variadic = True
        elif len(p) > 1 and is_op(p[1], "?") or any(is_op(x, "=") for x in p):
            most += 1
        else:
            least, most = least + 1, most + 1
    return least, None if variadic else most


def _typed_split(items: list) -> list[list]:
    """Pieces between commas that are not inside type arguments."""
    out, depth = [[]], 0
    for x in items:
        if is_op(x, "<"):
            depth += 1
        elif is_op(x, ">", ">>", ">>>"):
            depth = max(0, depth - len(x.text))
        if is_op(x, ",") and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return [p for p in out if p]


def _values(items: list, at: int) -> int:
    """Index of the ``=`` of the declarator whose name stands at ``at``, or -1: a type may stand between."""
    k = at + 1
    while k < len(items) and not is_op(items[k], "=", ",", ";"):
        if is_word(items[k], "of", "in"):
            return -1
        k += 1
    return k if k < len(items) and is_op(items[k], "=") else -1


def names(items: list, reads: bool = True) -> list[str]:
    """Identifiers used as values: no members, no object keys, no words of the language."""
    out = []
    for k, x in enumerate(items):
        if isinstance(x, Group):
            out += names(x.items)
        elif x.kind == "id":
            member = k and is_op(items[k - 1], ".", "?.")
            key = k + 1 < len(items) and is_op(items[k + 1], ":") and (k == 0 or is_op(items[k - 1], ",", "{"))
            if not member and not key and (x.text not in TS.keywords or x.text in ("async", "from", "get", "set", "type")) and x.text not in ("this", "super", "null", "true", "false", "undefined"):
                out.append(x.text)
        else:
            for part in x.parts:
                out += names(part)
    return out


_AUGMENTED = frozenset("+= -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??=".split())


def flow(s: list) -> tuple[list[str], list[str]]:
    """Names that a statement writes and reads."""
    writes, reads = [], []
    if is_word(s[0], "for"):
        head = next((x for x in s if is_group(x, "(")), None)
        classic = head is not None and any(is_op(x, ";") for x in head.items)
        at = s.index(head) + 1 if head is not None else 1
        if head is not None:
            for p in split(head.items, ";"):
                w, r = flow(p) if p else ([], [])
                writes += w
                reads += [] if classic else r + ([] if classic else w)
            if not classic:
                writes = []
        for p in ([s[at].items] if at < len(s) and is_group(s[at], "{") else [s[at:]]):
            w, r = _inner(p)
            writes += w
            reads += r
        return writes, reads
    return _inner(s)


def _inner(items: list) -> tuple[list[str], list[str]]:
    writes, reads = [], []
    for piece in split(items, ";", ","):
        if not piece:
            continue
        declares = next((k for k, x in enumerate(piece) if is_word(x, "const", "let", "var")), None)
        at = next((k for k, x in enumerate(piece) if is_op(x, "=") or isinstance(x, Tok) and x.text in _AUGMENTED), None)
        if at is not None:
            left = piece[: at] if declares is None else piece[declares + 1 : at]
            if declares is not None:
                left = split(left, ":")[0]
            lead = 0
            for k, x in enumerate(left):  # what stands before the target: a condition, a keyword
                if is_word(x) and x.text in TS.keywords and x.text not in TS.values:
                    lead = k + 1
            reads += names([x for x in left[:lead]])
            target = left[lead:]
            groups = [x for x in target if isinstance(x, Group) and x.kind == "("]
            reads += [n for g in groups for n in names(g.items)] if not declares and target and isinstance(target[0], Group) and target[0].kind == "(" else []
            writes += names(target)
            if piece[at].text != "=":
                reads += names(target)
            w, r = _inner(piece[at + 1 :])
            writes += w
            reads += r
            continue
        if declares is not None:
            rest = split(piece[declares + 1 :], ":")[0]
            writes += names(rest)
            continue
        w, r = _groups(piece)
        writes += w
        reads += r
    return writes, reads


def _groups(piece: list) -> tuple[list[str], list[str]]:
    writes, reads, plain = [], [], []
    for x in piece:
        if isinstance(x, Group) and x.kind in "{(" and any(is_op(y, "=", ";", *_AUGMENTED) or is_word(y, "const", "let", "var") for y in x.items):
            w, r = _inner(x.items)
            writes += w
            reads += r
            plain.append(Tok("op", ",", x.start, x.end))
        else:
            plain.append(x)
    return writes, reads + names(plain)


def _quoted(x) -> str | None:
    if isinstance(x, Tok) and x.kind == "str" and len(x.text) >= 2 and x.text[0] in "'\"" and x.text[-1] == x.text[0]:
        return x.text[1:-1]
    return None


def parse(text: str) -> Parsed:
    src = Source(text)
    out = Parsed()
    top = nested(Lexer(text, "ts").run())
    scorer = Scorer(src, TS, stop)

    def unit(f: Function, start: int, name: str, scope: list[str]) -> None:
        own: list[tuple[int, int, str]] = []
        body = f.body.items if isinstance(f.body, Group) else f.body
        calls(body, TS, lambda s, e, a, b, g: own.append((s, e, text[a:b].strip())), lambda items, i: _skip(items, i))
        cc = scorer.block(body, 0) if isinstance(f.body, Group) else scorer.expression(body, 0)
        out.functions.append(function(src, ".".join([*scope, name]), start, f.end, cc, in_stack_order(own)))
        walk(body, [*scope, name])

    def body_row(f: Function, name: str) -> None:
        if isinstance(f.body, Group):
            out.bodies.append({"name": name, "range": span(src, f.start, f.end), "statements": statement_rows(f.body, src, TS, flow)})

    def define(name: str, f: Function, start: int) -> None:
        a = arity(f.params)
        if a:
            out.definitions.append({"name": name, "min_args": a[0], "max_args": a[1], "range": span(src, start, f.end)})

    def walk(items: list, scope: list[str]) -> None:
        i, declaring = 0, False
        while i < len(items):
            x = items[i]
            if is_word(x, "class") and not (i and is_op(items[i - 1], ".", "?.", ":")):
                b = next((k for k in range(i + 1, len(items)) if is_group(items[k], "{")), None)
                if b is not None:
                    name = items[i + 1].text if is_word(items[i + 1]) and items[i + 1].text not in ("extends", "implements") else "<anon>"
                    walk(items[b].items, [*scope, name])
                    i = b + 1
                    continue
            if is_word(x, "const", "let", "var"):
                declaring = True
                i += 1
                continue
            if is_op(x, ";"):
                declaring = False
            if declaring and is_word(x) and (is_word(items[i - 1], "const", "let", "var") or is_op(items[i - 1], ",")):
                eq = _values(items, i)
                f = function_at(items, eq + 1) if eq >= 0 and eq + 1 < len(items) else None
                if f:
                    unit(f[0], x.start, x.text, scope)
                    define(x.text, f[0], x.start)
                    body_row(f[0], ".".join([*scope, x.text]))
                    i = f[1]
                    continue
            f = function_at(items, i)
            if f and f[0].kind == "function" and f[0].name and not _in_expression(items, i):
                unit(f[0], f[0].start, f[0].name, scope)
                define(f[0].name, f[0], f[0].start)
                body_row(f[0], ".".join([*scope, f[0].name]))
                i = f[1]
                continue
            if f:  # an anonymous function is no unit, but may hold some
                if f[0].params:
                    walk(f[0].params.items, scope)
                body_row(f[0], ".".join([*scope, f[0].name or "<anon>"]))
                walk(f[0].body.items if isinstance(f[0].body, Group) else f[0].body, scope)
                i = max(f[1], i + 1)
                continue
            m = method_at(items, i)
            if m:
                unit(m[0], m[0].start, m[0].name, scope)
                body_row(m[0], ".".join([*scope, m[0].name]))
                i = m[1]
                continue
            if isinstance(x, Group):
                walk(x.items, scope)
            else:
                for part in x.parts:
                    walk(part, scope)
            i += 1

    walk(top, [])

    def site(s: int, e: int, a: int, b: int, g: Group) -> None:
        callee = text[a:b]
        if "." not in callee and "[" not in callee:
            out.calls.append({"callee": callee, "argc": argc(g), "range": span(src, s, e)})
        if callee in ("require", "import"):
            out.imports += [{"module": q, "range": span(src, s, e)} for x in g.items if (q := _quoted(x)) is not None]
        if callee.endswith(_BINDINGS):
            out.bindings += [{"callee": callee, "name": q, "range": span(src, x.start, x.end)} for p in split(g.items, ",") if len(p) == 1 for x in p if (q := _quoted(x)) is not None]

    calls(top, TS, site, _declaration_head)
    for i, x in _everywhere(top):
        if is_word(x[i], "import") and not (i + 1 < len(x) and is_group(x[i + 1], "(")) and not (i and is_op(x[i - 1], ".")):
            found = _import(x, i)
            if found:
                out.imports.append({"module": found[0], "range": span(src, x[i].start, found[1])})
    return out


def _value(items: list) -> tuple[str, list[list]]:
    first = items[0]
    if len(items) == 1 and isinstance(first, Tok) and first.kind == "str":
        return ("fstr" if first.text.startswith("`") and first.parts else "str"), []
    if len(items) == 1 and isinstance(first, Tok) and first.text.startswith("`") and first.parts:
        return "fstr", []
    pieces = [p for p in split(items, "+") if p]
    return ("plus", pieces) if len(pieces) > 1 else ("expr", [])


def nodes(text: str, keep=None) -> list[dict]:
    """Calls with their callee (``new`` before that of a construction), arguments and their values."""
    src = Source(text)
    out = Nodes(src)
    top = nested(Lexer(text, "ts").run())

    def put(s: int, e: int, callee: str, g: Group) -> None:
        args = [p for p in split(g.items, ",") if p]
        out.put("call", s, e, callee, n=len(args))
        arguments(out, text, g, args, lambda p: ("", p), _value)

    calls(top, TS, lambda s, e, a, b, g: put(s, e, "".join(text[a:b].split()), g), _declaration_head)
    for i, x in _everywhere(top):
        if is_word(x[i], "new") and i + 2 < len(x) and is_word(x[i + 1]) and is_group(x[i + 2], "("):
            put(x[i].start, x[i + 2].end, f"new {x[i + 1].text}", x[i + 2])
    return out.rows(keep)


def _everywhere(items: list):
    for i, x in enumerate(items):
        yield i, items
        if isinstance(x, Group):
            yield from _everywhere(x.items)


def _import(items: list, i: int) -> tuple[str, int] | None:
    """Module and end of an import statement."""
    for k in range(i + 1, min(len(items), i + 40)):
        x = items[k]
        if isinstance(x, Tok) and x.kind == "str":
            if k == i + 1 or is_word(items[k - 1], "from"):
                end = items[k + 1].end if k + 1 < len(items) and is_op(items[k + 1], ";") else x.end
                q = _quoted(x)
                return (q, end) if q is not None else None
            return None
        if is_op(x, ";", "=") or is_word(x, "import", "const", "let", "function", "class"):
            return None
    return None


def _in_expression(items: list, i: int) -> bool:
    """Whether a function at ``i`` is a value: of an assignment, an argument, a result."""
    if i == 0:
        return False
    p = items[i - 1]
    return isinstance(p, Tok) and (p.kind == "op" and p.text not in (";", ")", "@") or is_word(p, "return", "new", "typeof", "await", "yield", "void", "in", "of"))


def _skip(items: list, i: int) -> int | None:
    """For callees: functions and classes inside a body keep their calls to themselves."""
    if is_word(items[i], "class"):
        b = next((k for k in range(i + 1, len(items)) if is_group(items[k], "{")), None)
        if b is not None:
            return b + 1
    return stop(items, i)


def _declaration_head(items: list, i: int) -> int | None:
    """For call sites: steps over the name of a function or method, whose parameter list is no call."""
    x = items[i]
    if is_word(x, "function"):
        p = next((k for k in range(i + 1, min(i + 4, len(items))) if is_group(items[k], "(")), None)
        return p if p is not None else None
    if is_word(x) and (not i or not is_op(items[i - 1], ".", "?.")) and i + 1 < len(items) and is_group(items[i + 1], "(") and method_at(items, i):
        return i + 1
    return None
