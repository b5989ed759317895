"""Front end for Python: lines to an indentation tree, and what the relations need of it.

It works on broken files: whatever a line can't be understood as is an expression.  Lines without strings and comments that are whole
by themselves are looked at once for all places where they read the same, up to a bound (``KEPT``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from corvane.parse.lexer import BLANKS, Group, Lexer, Source, Tok, nested, opens, split
from corvane.parse.model import Nodes, Parsed, arguments, distinct, function, in_stack_order, label, span

KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_BLOCKS = frozenset("if elif else for while try except finally with def class match case".split())
_AUGMENTED = frozenset("+= -= *= /= //= %= **= @= &= |= ^= >>= <<=".split())
_VALUE_WORDS = frozenset(("None", "True", "False"))


#: Lines that are kept, and characters of the longest.
KEPT, LONGEST = 1 << 12, 160
#: What a line must not hold to be told by itself.
_OTHER = re.compile(r"[#\\'\"]")


class Form:
    """A statement as far as its own line tells: ``word`` is its keyword or empty, ``head`` its items (those before the colon of a block), ``body`` what follows on the line.

    Places count from the beginning of ``text``.  What is asked of it is kept, as lines that read the same share it.
    """

    __slots__ = ("text", "word", "head", "start", "end", "block", "body", "_costs", "_called", "_sites", "_flow", "_nodes")

    def __init__(self, text: str, word: str, head: list, start: int, end: int, block: bool = False, body: tuple["Form", ...] = ()):
        self.text, self.word, self.head, self.start, self.end, self.block, self.body = text, word, head, start, end, block, body
        self._costs: dict = {}
        self._called = self._sites = self._flow = self._nodes = None

    def cost(self, nesting: int, skip: int = 0) -> int:
        """Complexity of its expressions, without its first item if that is a keyword."""
        if (nesting, skip) not in self._costs:
            self._costs[nesting, skip] = expression(self.head[skip:], nesting)
        return self._costs[nesting, skip]

    def called(self) -> list[tuple[int, int, str]]:
        """Its calls with the callees' texts."""
        if self._called is None:
            out: list = []
            calls(self.head, lambda s, e, a, b, _: out.append((s, e, self.text[a:b].strip())))
            self._called = out
        return self._called

    def sites(self) -> list[tuple[int, int, str, int]]:
        """Its calls of plain names with the number of arguments."""
        if self._sites is None:
            head, out = self.head, []
            if self.word in ("def", "class") and self.block:  # the parameter list of a definition is no call
                at = next((k for k, x in enumerate(head) if isinstance(x, Group)), None)
                head = [] if at is None else [head[at], Tok("op", ",", 0, 0), *head[at + 1 :]]

            def site(s: int, e: int, a: int, b: int, g: Group) -> None:
                callee = self.text[a:b]
                if "." not in callee:
                    out.append((s, e, callee, argc(g)))

            calls(head, site)
            self._sites = out
        return self._sites

    def flow(self) -> tuple[list[str], list[str]]:
        """Names that it writes and reads itself."""
        if self._flow is None:
            self._flow = _own_flow(self)
        return self._flow

    def nodes(self) -> tuple[str, list[tuple]]:
        """Its head without blanks, and the nodes of its calls."""
        if self._nodes is None:
            out, text = Nodes(None), self.text

            def call(s: int, e: int, a: int, b: int, g: Group) -> None:
                args = [p for p in split(g.items, ",") if p]
                out.put("call", s, e, "".join(text[a:b].split()), n=len(args))
                arguments(out, text, g, args, _keyword, _value)

            calls(self.head if self.word != "def" else [x for x in self.head if isinstance(x, Group)], call)
            inner = self.head[1:] if self.word else self.head
            self._nodes = "".join(text[inner[0].start : inner[-1].end].split()) if inner else "", out.found
        return self._nodes


class Node:
    """A statement at its place: its form begins at ``base``, and ``body`` is its block."""

    __slots__ = ("form", "word", "block", "base", "start", "end", "indent", "body")

    def __init__(self, form: Form, base: int, indent: int):
        self.form, self.word, self.block, self.base = form, form.word, form.block, base
        self.start, self.end, self.indent = base + form.start, base + form.end, indent
        self.body = [Node(f, base, indent + 1) for f in form.body]


@lru_cache(KEPT)
def _line(text: str) -> tuple[int | None, list[Form]] | None:
    """Where a line's first item begins and its statements; nothing if it goes on after its end."""
    tokens = Lexer(text, "python").run()
    return None if opens(tokens) else _said(nested(tokens), text)


def _said(items: list, text: str) -> tuple[int | None, list[Form]]:
    return items[0].start if items else None, _forms(items, text)


def _lines(src: Source) -> Iterator[tuple[int, list[Form], int]]:
    """Where the first item of each logical line begins, its statements, and where the text lies from whose beginning these count."""
    text, at = src.text, 0
    while at < len(text):
        end = text.find("\n", at)
        if end < 0:
            end = len(text)
        line = text[at:end].lstrip(BLANKS)
        base, at = end - len(line), end + 1
        if not line:
            continue
        found = _line(line) if len(line) <= LONGEST and not _OTHER.search(line) else None
        if found is None:
            lexer = Lexer(text, "python", base)
            found, base, at = _said(nested(lexer.logical(), recover=True), text), 0, lexer.i
        first, forms = found
        if first is not None:
            yield base + first, forms, base


def tree(src: Source) -> list[Node]:
    root = Node(Form("", "", [], 0, 0, True), 0, -1)
    stack = [root]
    for first, forms, base in _lines(src):
        indent = _indent(src, first)
        while len(stack) > 1 and indent <= stack[-1].indent:
            stack.pop()
        for form in forms:
            node = Node(form, base, indent)
            stack[-1].body.append(node)
            if node.block and not node.body:
                stack.append(node)
    _close(root)
    return root.body


def _indent(src: Source, start: int) -> int:
    """Width of the blanks before a line's first token; a tab goes to the next multiple of 8."""
    at, width = src.starts[src.line(start)], 0
    for c in src.text[at:start]:
        width = (width // 8 + 1) * 8 if c == "\t" else width + 1
    return width


def _forms(line: list, text: str) -> list[Form]:
    out: list[Form] = []
    at = 0
    while at < len(line):
        word = line[at].text if isinstance(line[at], Tok) and line[at].kind == "id" else ""
        if word == "async" and at + 1 < len(line) and line[at + 1].text in ("def", "for", "with"):
            word = line[at + 1].text
        colon = None
        if word in _BLOCKS and (word not in ("match", "case") or _soft(line[at:])):
            for k in range(at + 1, len(line)):
                if line[k].text == ":" and _is(line[k], ":") and not _lambda(line, at, k):
                    colon = k
                    break
        if colon is not None:
            out.append(Form(text, word, line[at:colon], line[at].start, line[colon].end, True, tuple(_forms(line[colon + 1 :], text))))
            return out
        stop = len(line)
        for k in range(at, stop):
            if line[k].text == ";" and _is(line[k], ";"):
                stop = k
                break
        if stop > at:
            out.append(Form(text, word if word in KEYWORDS else "", line[at:stop], line[at].start, line[stop - 1].end))
        at = stop + 1
    return out


def _soft(line: list) -> bool:
    """Whether ``match`` or ``case`` begins a block: it is followed by an operand and the line ends in a colon."""
    follows = line[1] if len(line) > 1 else None
    operand = isinstance(follows, Group) or isinstance(follows, Tok) and (follows.kind in ("id", "num", "str") or follows.text in ("-", "*", "_"))
    return operand and (_is(line[-1], ":") or line[0].text == "case" and any(_is(x, ":") for x in line))


def _is(x, text: str) -> bool:
    return isinstance(x, Tok) and x.kind == "op" and x.text == text


def _lambda(line: list, start: int, colon: int) -> bool:
    """Whether the colon belongs to a lambda: more of these than colons stand before it."""
    words = sum(isinstance(x, Tok) and x.text == "lambda" for x in line[start:colon])
    return words > sum(_is(x, ":") for x in line[start:colon])


def _close(node: Node) -> int:
    for child in node.body:
        node.end = max(node.end, _close(child))
    return node.end


# --- expressions ----------------------------------------------------------------------------------------------


def _word(x, *texts: str) -> bool:
    return isinstance(x, Tok) and x.kind == "id" and x.text in texts


def calls(items: list, emit) -> None:
    """Calls ``emit(start, end, callee start, callee end, argument group)`` for every call in the items, at any depth."""
    i = 0
    while i < len(items):
        x = items[i]
        if isinstance(x, Group):
            calls(x.items, emit)
        else:
            for part in x.parts:
                calls(part, emit)
        if isinstance(x, Group) or x.kind in ("str", "num") or x.kind == "id" and (x.text not in KEYWORDS or x.text in _VALUE_WORDS):
            start, end, k = x.start, x.end, i + 1
            while k < len(items):
                y = items[k]
                if _is(y, ".") and k + 1 < len(items) and isinstance(items[k + 1], Tok) and items[k + 1].kind == "id":
                    end, k = items[k + 1].end, k + 2
                elif isinstance(y, Group) and y.kind in "([":
                    calls(y.items, emit)
                    if y.kind == "(":
                        emit(start, y.end, start, end, y)
                    end, k = y.end, k + 1
                elif isinstance(y, Tok) and y.kind == "str" and x.kind == "str":
                    for part in y.parts:
                        calls(part, emit)
                    end, k = y.end, k + 1
                else:
                    break
            i = k
        else:
            i += 1


def argc(group: Group) -> int:
    """Number of arguments; a lone generator counts its element, its loops and its conditions."""
    pieces = [p for p in split(group.items, ",") if p]
    if len(pieces) == 1 and any(_word(x, "for") for x in pieces[0]):
        loops = [k for k, x in enumerate(pieces[0]) if _word(x, "for")]
        ifs = sum(_word(x, "if") for x in pieces[0][loops[0] :]) - sum(_word(x, "else") for x in pieces[0][loops[0] :])
        return 1 + len(loops) + max(ifs, 0)
    return len(pieces)


def expression(items: list, nesting: int) -> int:
    """Complexity of expressions: conditionals, and changes of the boolean operator within one bracket."""
    total = 0
    for x in items:
        if isinstance(x, Tok):
            total += sum(expression(p, nesting) for p in x.parts)
    pieces = [[]]
    k = 0
    loop = False
    while k < len(items):
        x = items[k]
        if _word(x, "lambda"):  # its body is a function of its own
            while k < len(items) and not _is(items[k], ":"):
                k += 1
            while k < len(items) and not _is(items[k], ","):
                k += 1
            continue
        if isinstance(x, Tok) and x.kind == "op" and (x.text in (",", ":", "=", ":=", "->") or x.text in _AUGMENTED) or _word(x, "for") or loop and _word(x, "in"):
            loop = _word(x, "for")
            pieces.append([x] if loop else [])
        elif _word(x, "return", "yield", "await", "raise", "assert", "del", "from", "async", "as", "if") and not pieces[-1]:
            pass
        else:
            pieces[-1].append(x)
        k += 1
    comprehension = any(_word(x, "for") for x in items)
    for p in pieces:
        total += _piece([x for x in p if not _word(x, "for")], nesting, comprehension)
    return total


def _piece(items: list, nesting: int, comprehension: bool) -> int:
    at = next((k for k, x in enumerate(items) if _word(x, "if")), None)
    if at is not None:
        depth, other = 0, None
        for k in range(at + 1, len(items)):
            depth += _word(items[k], "if")
            if _word(items[k], "else"):
                if not depth:
                    other = k
                    break
                depth -= 1
        if other is None:
            return _piece(items[:at], nesting, comprehension) + _piece(items[at + 1 :], nesting, comprehension)
        inner = (items[:at], items[at + 1 : other], items[other + 1 :])
        return 1 + nesting + sum(_piece(p, nesting + 1, comprehension) for p in inner)
    total = sum(expression(x.items, nesting) for x in items if isinstance(x, Group))
    terms, ands = 1, [0]
    for x in items:
        if _word(x, "or"):
            terms += 1
            ands.append(0)
        elif _word(x, "and"):
            ands[-1] += 1
    return total + (terms > 1) + sum(a > 0 for a in ands)


def complexity(body: list[Node], nesting: int = 0) -> int:
    total = 0
    for n in body:
        w = n.word
        if w in ("def",):
            continue
        if w in ("if", "for", "while", "match", "except", "case"):
            inner = nesting + 1
            total += 1 + nesting
            total += n.form.cost(inner, 1) + complexity(n.body, inner)
        elif w in ("elif", "else"):
            own = nesting + 1 if w == "elif" or _belongs(body, n) in ("if", "elif", "for", "while") else nesting
            total += 1 + n.form.cost(own, 1) + complexity(n.body, own)
        elif n.block:
            total += n.form.cost(nesting, 1) + complexity(n.body, nesting)
        else:
            total += (w in ("break", "continue", "raise") and nesting > 0) + n.form.cost(nesting)
    return total


def _belongs(body: list[Node], node: Node) -> str:
    """Keyword of the statement that an ``else`` ends."""
    for n in reversed(body[: body.index(node)]):
        if n.word in ("if", "elif", "for", "while", "try", "except"):
            return n.word
    return ""


# --- relations ----------------------------------------------------------------------------------------------------


def parameters(group: Group, name: str) -> tuple[int, int | None]:
    """Least and most arguments; only a constructor's first parameter is left out, and a typed splat counts as required."""
    least = most = 0
    variadic, skip = False, name == "__init__"
    for p in split(group.items, ","):
        if not p or len(p) == 1 and (_is(p[0], "/") or _is(p[0], "*")):
            continue
        typed, default = any(_is(x, ":") for x in p), any(_is(x, "=") for x in p)
        if isinstance(p[0], Group) or not typed and (_is(p[0], "*") or _is(p[0], "**")):
            variadic = True
        elif default:
            most += 1
        elif skip:
            skip = False
        else:
            least, most = least + 1, most + 1
    return least, None if variadic else most


def _name(form: Form) -> Tok | None:
    return next((x for k, x in enumerate(form.head) if k and isinstance(x, Tok) and x.kind == "id" and x.text not in ("def", "class")), None)


def _own_calls(body: list[Node], out: list[tuple[int, int, str]]) -> None:
    """Calls of a body without those of nested functions and classes."""
    for n in body:
        if n.word not in ("def", "class"):
            out += [(n.base + s, n.base + e, callee) for s, e, callee in n.form.called()]
            _own_calls(n.body, out)


def names(items: list) -> list[str]:
    out = []
    for x in items:
        if isinstance(x, Group):
            out += names(x.items)
        elif x.kind == "id":
            if x.text not in KEYWORDS:
                out.append(x.text)
        else:
            for part in x.parts:
                out += names(part)
    return out


def _own_flow(n: Form) -> tuple[list[str], list[str]]:
    writes, reads = [], []
    if n.word == "for" and n.block:
        at = next((k for k, x in enumerate(n.head) if _word(x, "in")), len(n.head))
        start = next((k for k, x in enumerate(n.head) if _word(x, "for")), 0)
        writes += names(n.head[start + 1 : at])
        reads += names(n.head[at + 1 :])
    elif n.block or n.word:
        reads += names(n.head)
    else:
        pieces = split(n.head, "=")
        op = next((k for k, x in enumerate(n.head) if isinstance(x, Tok) and x.text in _AUGMENTED), None)
        if op is not None:
            writes += names(n.head[:op])
            reads += names(n.head)
        elif len(pieces) > 1:
            for p in pieces[:-1]:
                left = split(p, ":")[0]
                writes += names(left)
            reads += names(pieces[-1])
        else:
            piece = split(n.head, ":")
            if len(piece) > 1 and not _word(n.head[0], "lambda"):
                writes += names(piece[0])
            else:
                reads += names(n.head)
    return distinct(writes), distinct(reads)


def flow(n: Node) -> tuple[list[str], list[str]]:
    """Names that a statement writes and reads, with those of its block."""
    writes, reads = n.form.flow()
    if not n.body:
        return writes, reads
    each = [flow(child) for child in n.body]
    return distinct([*writes, *(w for ws, _ in each for w in ws)]), distinct([*reads, *(r for _, rs in each for r in rs)])


_JOINED = ("elif", "else", "except", "finally")


def grouped(body: list[Node]) -> list[list[Node]]:
    """Statements with the clauses that belong to them."""
    out: list[list[Node]] = []
    for n in body:
        if n.word in _JOINED and n.block and out:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def parse(text: str, bodies: bool = True) -> Parsed:
    """What is found in a file; the statements of functions only with ``bodies``."""
    src = Source(text)
    out = Parsed()
    top = tree(src)

    def walk(body: list[Node], scope: list[str], outer: bool) -> None:
        for n in body:
            if outer and n.word in ("import", "from") and not n.block:
                module = _module(n.form)
                if module is not None:
                    out.imports.append({"module": module, "range": span(src, n.start, n.end)})
            name = _name(n.form) if n.word in ("def", "class") and n.block else None
            if n.word == "def" and name:
                own: list[tuple[int, int, str]] = []
                _own_calls(n.body, own)
                out.functions.append(function(src, ".".join([*scope, name.text]), n.start, n.end, complexity(n.body), in_stack_order(own)))
                params = next((x for x in n.form.head if isinstance(x, Group) and x.kind == "("), None)
                if params:
                    least, most = parameters(params, name.text)
                    out.definitions.append({"name": name.text, "min_args": least, "max_args": most, "range": span(src, n.start, n.end)})
                statements = []
                for g in grouped(n.body) if bodies else ():
                    start, end = g[0].start, g[-1].end
                    pairs = [flow(x) for x in g]
                    loop = g[0].word == "for"
                    reads = [r for k, (_, r) in enumerate(pairs) if not (loop and k) for r in r]
                    statements.append({"range": span(src, start, end), "label": label(text[start:end]), "writes": distinct(w for w, _ in pairs for w in w), "reads": distinct(reads)})
                if bodies:
                    out.bodies.append({"name": ".".join([*scope, name.text]), "range": span(src, n.start, n.end), "statements": statements})
            walk(n.body, [*scope, name.text] if name else scope, False)

    walk(top, [], True)

    def sites(body: list[Node]) -> None:
        for n in body:
            for s, e, callee, many in n.form.sites():
                out.calls.append({"callee": callee, "argc": many, "range": span(src, n.base + s, n.base + e)})
            sites(n.body)

    sites(top)
    return out


def _module(n: Form) -> str | None:
    """First segment of the first imported module; null for relative imports."""
    first = n.head[1] if len(n.head) > 1 else None
    if not isinstance(first, Tok) or first.kind != "id" or n.word == "import" and first.text in KEYWORDS:
        return None
    return first.text


# --- nodes ------------------------------------------------------------------------------------------------------------


def _value(items: list) -> tuple[str, list[list]]:
    first = items[0]
    if isinstance(first, Tok) and first.kind == "str" and first.parts:
        return "fstr", []
    if len(items) == 1 and isinstance(first, Tok) and first.kind == "str":
        return "str", []
    pieces = [p for p in split(items, "+") if p]
    return ("plus", pieces) if len(pieces) > 1 else ("expr", [])


def _keyword(items: list) -> tuple[str, list]:
    return (items[0].text, items[2:]) if len(items) > 2 and _is(items[1], "=") and isinstance(items[0], Tok) else ("", items)


def nodes(text: str, keep=None) -> list[dict]:
    """Statements with their keyword and head, calls with their callee, arguments with their names and values.

    A clause of a try statement begins with the statement, so it holds what it belongs to.
    """
    src = Source(text)
    out = Nodes(src)

    def walk(body: list[Node]) -> None:
        begin = 0
        for n in body:
            if n.word == "try":
                begin = n.start
            start = begin if n.word in ("except", "else", "finally") and n.block else n.start
            said, found = n.form.nodes()
            out.put("stmt", start, n.end, n.word, said, n=len(n.body))
            out.found += [(n.base + s, e - n.base, *rest) for s, e, *rest in found]
            walk(n.body)

    walk(tree(src))
    return out.rows(keep)
