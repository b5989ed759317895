"""Personal data by anchor expansion.

One Aho-Corasick automaton walks each whole text and stops only at anchors: at-signs, plus signs, digits,
``://`` and identifier cues (``password``, ``token``, ``iban``, ``account`` and the like).  At each anchor
deterministic local parsers expand to the left and right and validate what they find.  A parser never
looks again at what an earlier match or attempt of its kind has covered, so the work stays linear in the text.

Base kinds: ``email``, ``ip``, ``card`` and ``phone``.  Kinds that the method adds:
    secret   the value after ``password``, ``token``, ``secret`` or ``api key``, or a name that ends so, and ``=`` or ``:``
    login    ``user:password`` of any length before the host of a URL
    iban     after its cue, valid by its remainder mod 97
    ssn      after its cue, ``ddd-dd-dddd``
    account  6 to 17 digits after ``account``, ``acct`` or ``account number``
    address  a house number and one to four capitalised words, of at most 31 characters each, before a street word

Cues are met in any case; but for secrets, a cue begins a word, or a part of a name written like ``userAccount``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.shipping import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "login", "iban", "ssn", "account", "address")

_CUES = {
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey", "api key", "api-key"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security number"),
    "account": ("account", "acct"),
    "address": ("street", "avenue", "road", "boulevard", "lane"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"""["']?[ \t]?[=:][ \t]?["']?([^\s"',;]{6,})""")
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[ :#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|#))?[ :#]{0,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_LOGIN = re.compile(r"[^\s/@:]++:[^\s/@]++(?=@[A-Za-z0-9-])")  # never reads past the next slash, so a text is read once for all its URLs
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HOUSE = re.compile(r"(?<![^\s,;(])[0-9]{1,5}[A-Za-z]?(?: [A-Z][A-Za-z'.-]{0,30}){1,4} $")


def automaton() -> ahocorasick.Automaton:
    """Anchors with their kind of parser, for lower-cased texts."""
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("login", 3))
    for kind, cues in _CUES.items():
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """The text in lower case with every character in its place: where one would become two, only A to Z are lowered."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind as code-point offsets, in order; spans of one kind never overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    seen = dict.fromkeys((*KINDS, "digits"), 0)  # for each kind, where its next match may begin
    for last, (kind, size) in anchors.iter(lowered(text)):
        start = last + 1 - size
        if kind == "digit":
            if start >= seen["card"]:
                m = _DIGITS.match(text, start)
                seen["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if start >= seen["ip"]:
                m = _DOTTED.match(text, start)
                seen["ip"] = m.end()
                if m[0].count(".") >= 3:
                    parts, at = m[0].split("."), start
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        stop = at + sum(map(len, four)) + 3
                        if all(len(q := p.lstrip("0") or "0") < 4 and int(q) <= 255 for p in four):
                            out["ip"].append((at, stop))
                        at = stop + 1
        elif kind == "email":
            left = start
            while left > seen["email"] and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, last + 1)):
                out["email"].append((left, m.end()))
                seen["email"] = m.end()
            else:
                seen["email"] = max(seen["email"], last + 1)
        elif kind == "phone":
            if start >= seen["phone"] and (m := _PHONE.match(text, start)):
                seen["phone"] = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif start >= seen[kind]:
            if kind == "address":
                if last + 1 < len(text) and text[last + 1].isalnum() or not text[start].isupper():
                    continue
                low = max(seen[kind], start - 140)
                if m := _HOUSE.search(text[low:start]):
                    out[kind].append((low + m.start(), last + 1))
                    seen[kind] = last + 1
                continue
            inner = start and text[start - 1].isalnum()
            if inner and kind not in ("login", "secret") and not (text[start].isupper() and not text[start - 1].isupper()):
                continue
            m = {"secret": _SECRET, "iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT, "login": _LOGIN}[kind].match(text, last + 1)
            if m is None:
                continue
            span = m.span() if kind == "login" else m.span(1)
            if kind == "iban":
                body = m[1]
                while body and not iban_valid(body):
                    body = body[:-1].rstrip()
                span = (span[0], span[0] + len(body))
            if span[0] < span[1]:
                out[kind].append(span)
                seen[kind] = span[1]
    return out


def ordered(found: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by its (first) kind in capitals."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _found(mask: bool):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, len(texts), 500):
                part = texts.slice(at, 500).to_pylist()
                spans = [ordered(find(t, anchors)) if t else [] for t in part]
                new = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], pa.list_(struct))]
                if mask:
                    new.append(pa.array([masked(t, s) if s else t for t, s in zip(part, spans, strict=True)], pa.string()))
                kept = [c.slice(at, 500) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*batch.schema.names[:-1], "spans", *(["masked"] if mask else [])])

    return found


def spans(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), mask: bool = False) -> DataFrame:
    """``(keep..., spans)`` and, if asked for, ``masked``: the text without its personal data.

    ``spans`` is an array of ``(kind, start, end)`` in code points, by kind as listed and then by start.
    A null or empty text has none, and masks to itself.  Repeated rows come back as often; other columns are
    ignored; an empty table stays empty.
    """
    out = _rows(docs, text_col, keep, mask)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "spans", *(["masked"] if mask else []))


def _rows(docs: DataFrame, text_col: str, keep: tuple[str, ...], mask: bool) -> DataFrame:
    """The columns ``keep`` as ``_k0``, ``_k1`` and so on, with ``spans`` and, if asked for, ``masked``."""
    ship(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("_text"))
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "spans array<struct<kind:string,start:bigint,end:bigint>>", *(["masked string"] if mask else [])])
    return rows.mapInArrow(_found(mask), fields)


def masked_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns with personal data in the text replaced, and ``n_chars``, if there is one, counted anew.

    Other columns may have any names.  A null or empty text stays as it is; repeated rows come back as often; an empty table stays empty.
    """
    names = docs.columns
    others = tuple(c for c in names if c != text_col)
    again = {text_col: F.col("masked"), "n_chars": F.char_length("masked").cast("long")}
    kept = {c: F.col(f"_k{i}") for i, c in enumerate(others)}
    return _rows(docs, text_col, others, True).select(*((again[c] if c in again else kept[c]).alias(c) for c in names))
