"""What a front end finds in one file, as plain dictionaries that fit the silver schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from corvane.parse.lexer import Source


@dataclass
class Parsed:
    """Rows of one file; ranges are ``{"start": {line, col}, "end": {line, col}}``."""

    functions: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    definitions: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    bindings: list[dict] = field(default_factory=list)
    bodies: list[dict] = field(default_factory=list)


def span(src: Source, start: int, end: int) -> dict:
    a, b = src.at(start), src.at(end)
    return {"start": {"line": a[0], "col": a[1]}, "end": {"line": b[0], "col": b[1]}}


def distinct(names) -> list[str]:
    return list(dict.fromkeys(names))


def label(text: str) -> str:
    """First line of a statement, trimmed, at most 80 characters."""
    return text.split("\n", 1)[0].strip()[:80]


def function(src: Source, name: str, start: int, end: int, cc: int, callees: list[str]) -> dict:
    r = span(src, start, end)
    return {"name": name, "range": r, "cc": cc, "loc": r["end"]["line"] - r["start"]["line"] + 1, "callees": callees}


def in_stack_order(calls: list[tuple[int, int, str]]) -> list[str]:
    """Distinct callee texts as a walk meets them that goes from outside in and from right to left."""
    return distinct(text for _, _, text in sorted(calls, key=lambda c: (-c[1], c[0])))


class Nodes:
    """Nodes of a file by their extents: statements, calls, their arguments and what these hold."""

    _RANK = {"stmt": 0, "arg": 1, "call": 3}

    def __init__(self, src: Source):
        self.src, self.found = src, []

    def put(self, kind: str, start: int, end: int, word: str = "", text: str = "", ord: int = 0, of: int = 1, n: int = 0) -> None:  # noqa: A002
        self.found.append((start, -end, self._RANK.get(kind, 2), kind, word, text, ord, of, n))

    def rows(self, keep=None) -> list[dict]:
        """Numbered by their beginning, the longer first; parents are the innermost that hold them.  With ``keep(kind, word, n)`` only the rows of some nodes, numbered among all."""
        out, stack, k = [], [], -1

        def close() -> None:
            row = stack.pop()[2]
            if row is not None:
                row["last"] = k - 1

        for k, (start, end, _, kind, word, text, ord_, of, n) in enumerate(sorted(self.found)):
            while stack and (stack[-1][1] > end or -stack[-1][1] <= start):
                close()
            row = None
            if keep is None or keep(kind, word, n):
                row = {"id": k, "last": k, "parent": stack[-1][0] if stack else -1, "kind": kind, "word": word, "text": text, "ord": ord_, "of": of, "n": n, "range": span(self.src, start, -end)}
                out.append(row)
            stack.append((k, end, row))
        k += 1
        while stack:
            close()
        return out


def arguments(nodes: Nodes, text: str, group, args: list[list], keyword, value) -> None:
    """Puts the arguments of a call and their values; ``keyword(arg)`` gives a name and the items behind it, ``value(items)`` a kind and the pieces of a sum."""
    for i, p in enumerate(args):
        name, items = keyword(p)
        a, b = p[0].start, p[-1].end
        nodes.put("arg", a, b, name, ord=i, of=len(args))
        if not items:
            continue
        kind, pieces = value(items)
        nodes.put(kind, items[0].start, items[-1].end, text=text[items[0].start : items[-1].end].strip(), n=len(pieces))
        for k, piece in enumerate(pieces):
            nodes.put(value(piece)[0], piece[0].start, piece[-1].end, text=text[piece[0].start : piece[-1].end].strip(), ord=k, of=len(pieces))
