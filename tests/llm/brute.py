"""Plain-Python versions of the operators, written for small inputs and nothing else."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def shingles(text):
    w = words(lower(text))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def near_duplicates(rows, percent=85):
    """``(id, text)`` → ``(id, shingles, component)`` for each row, sorted."""
    sets = [(i, shingles(t)) for i, t in rows]
    named = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for k, (a, s) in enumerate(named) for b, t in named[k + 1 :] if 100 * len(s & t) >= percent * len(s | t)]
    comp = components({i for i, _ in named}, links)
    return sorted(((i, len(s), comp[i] if i is not None and s else i) for i, s in sets), key=str)


def quality(text):
    w = words(text)
    t = text or ""
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if words(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    counts = {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "n_lines": lines,
        "n_bangs": t.count("!"),
        "n_capitals": sum("A" <= c <= "Z" for c in t),
    }
    counts["base_failed"] = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
    return counts


def bin_of(x, accuracy=0.01):
    return -100_000 if x < 1e-6 else math.ceil(math.log(x) / math.log((1 + accuracy) / (1 - accuracy)))


def value_of(b, accuracy=0.01):
    g = (1 + accuracy) / (1 - accuracy)
    return 0.0 if b == -100_000 else g**b * 2 / (g + 1)


def quality_fences(rows, measures, group, reach):
    """``(id, text, lang, source)`` → counts of each row, and the fences of each language and source, drawn towards those of larger groups."""
    counts = [quality(t) for _, t, _, _ in rows]
    for c in counts:
        c["rates"] = {}
        for m in measures:
            a, b = m.expr.split(" / ")
            c["rates"][m.name] = c[a] / c[b] if c[b] else None
    pools = defaultdict(list)
    for (_, _, lang, source), c in zip(rows, counts, strict=True):
        if not c["base_failed"]:
            for key in (("all",), ("lang", lang), ("own", lang, source)):
                pools[key].append(c)

    def fence(pool, m):
        a, b = m.expr.split(" / ")
        bins = sorted(bin_of(c["rates"][m.name] if m.low else (c[a] / m.clump + 0.5) / c[b]) for c in pool)
        q25, q50, q75, q90 = (value_of(bins[math.ceil(len(bins) * p) - 1]) for p in (0.25, 0.5, 0.75, 0.9))
        often = 4 * sum(c["rates"][m.name] > 0 for c in pool) >= len(pool)
        return q25 + (q25 - q50) * reach if m.low else -1.0, q75 + (q75 - q50) * reach if often else q90 + (q90 - q50) * reach

    def drawn(key, m):
        ends = fence(pools[key], m)
        above = {"own": ("lang", key[1] if len(key) > 1 else None), "lang": ("all",)}.get(key[0])
        n = len(pools[key])
        if above is None:
            return ends
        (low, high), (low2, high2) = ends, drawn(above, m)
        return (low * n + low2 * group) / (n + group), math.exp((math.log(high) * n + math.log(high2) * group) / (n + group))

    return counts, {key: {m.name: drawn(key, m) for m in measures} for key in list(pools) if key[0] == "own"}


def quality_verdicts(rows, measures, group, reach, errors):
    """``(id, text, lang, source)`` → counts and verdict of each row, in order."""
    counts, fences = quality_fences(rows, measures, group, reach)
    out = []
    for (_, _, lang, source), c in zip(rows, counts, strict=True):
        ok = not c["base_failed"]
        for m in measures:
            if ok:
                a, b = m.expr.split(" / ")
                rate = c["rates"][m.name] if m.low else max(0, math.sqrt(c[a] / m.clump) - errors / 2) ** 2 / c[b]
                low, high = fences["own", lang, source][m.name]
                ok = low / 1.01 <= rate <= high / 0.99
        out.append((c, ok))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def personal_data(text):
    found = {k: [m.span() for m in re.finditer(p, text or "")] for k, p in PII.items()}
    cut = lambda s: re.sub("[^0-9]", "", text[s[0] : s[1]])
    found["ip"] = [s for s in found["ip"] if all(int(p) <= 255 for p in text[s[0] : s[1]].split("."))]
    found["card"] = [s for s in found["card"] if 16 <= len(cut(s)) <= 19 and luhn(cut(s))]
    found["phone"] = [s for s in found["phone"] if 8 <= len(cut(s)) <= 15]
    return found


def unigram(rows, held):
    """``(id, text)`` → ``(n_tokens, n_known, train tokens, base score)`` of each row."""
    tokens = [[*words(lower(t)), "\n"] for _, t in rows]
    counts = Counter(w for (i, _), ts in zip(rows, tokens, strict=True) if not held(i) for w in ts)
    n, v = sum(counts.values()), len(counts)
    return [(len(ts), sum(counts[w] > 0 for w in ts), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts)) for ts in tokens]


def class_model(rows, held, hashed, exchange, seed_words, head_words, classes, prior, least=2):
    """``(id, text)`` → log10 probability of each text under a class bigram model; ``exchange`` clusters the seeds' table of pairs."""
    texts = [[*words(lower(t)), "\n"] for _, t in rows]
    train = [ts for (i, _), ts in zip(rows, texts, strict=True) if not held(i)]
    counts = Counter(w for ts in train for w in ts if w != "\n")
    bands: dict = defaultdict(list)
    for w, c in counts.items():
        if c >= least:
            bands[math.floor(math.log2(c) * 8)].append(w)
    head: set = set()
    for b in sorted(bands, reverse=True):
        if len(head) + len(bands[b]) > head_words:
            break
        head |= set(bands[b])
    seeds = sorted(head, key=lambda w: (-counts[w], hashed(w)))[:seed_words]
    pairs = Counter((a, b) for ts in train for a, b in zip(["\n", *ts], ts, strict=False))

    def table(kind, n):
        out = [[0.0] * n for _ in range(n)]
        for (a, b), k in pairs.items():
            out[kind(a)][kind(b)] += k
        return out

    own = len(seeds)
    rank = {w: k for k, w in enumerate(seeds)}
    cls = exchange(table(lambda w: own + 1 if w == "\n" else rank.get(w, own), own + 2), own)
    n = min(classes, own)
    other, end, size = n, n + 1, n + 2
    of = {w: int(cls[k]) for w, k in rank.items()}
    looked = set(seeds)
    for _ in range(2):
        kind = lambda w: end if w == "\n" else of[w] if w in looked else other  # noqa: E731, B023
        t = table(kind, size)
        right, left = [sum(r) for r in t], [sum(r[k] for r in t) for k in range(size)]
        gains: dict = {w: [0.0] * n for w, c in counts.items() if c >= least and w not in rank}
        for (a, b), k in pairs.items():
            for c in range(n):
                if b in gains:
                    gains[b][c] += k * math.log((t[kind(a)][c] + 0.5) / (left[c] + 0.5 * size))
                if a in gains:
                    gains[a][c] += k * math.log((t[c][kind(b)] + 0.5) / (right[c] + 0.5 * size))
        for w, g in gains.items():
            g = [round(x, 9) for x in g]
            of[w] = g.index(max(g))
        looked = head
    kind = lambda w: end if w == "\n" else of.get(w, other)
    near = lambda w: w == "\n" or w in head
    t = [[0.0] * size for _ in range(size)]
    out, into, both = [0] * size, [0] * size, 0
    for (a, b), k in pairs.items():
        if near(a) or near(b):
            t[kind(a)][kind(b)] += k
        else:
            out[kind(a)] += k
            into[kind(b)] += k
            both += k
    for a in range(size):
        for b in range(size):
            t[a][b] += out[a] * into[b] / max(both, 1)
    mass = [sum(r[k] for r in t) for k in range(size)]
    share = [(m + 0.5) / (sum(mass) + 0.5 * size) for m in mass]
    step = [[math.log10((x + prior * q) / (sum(r) + prior)) for x, q in zip(r, share, strict=True)] for r in t]
    tokens = [sum(counts[w] for w in of if of[w] == c) for c in range(n)]
    rare = [c for w, c in counts.items() if w not in of]

    def word(w):
        if w == "\n":
            return 0.0
        return math.log10(counts[w] / tokens[of[w]]) if w in of else math.log10((counts[w] + 1) / (sum(rare) + len(rare) + 1))

    return [sum(step[kind(a)][kind(b)] + word(b) for a, b in zip(["\n", *ts], ts, strict=False)) for ts in texts]


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def license_places(text, templates):
    w = license_words(text)
    return [(name, i) for name, phrase in templates for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]


def license_notices(text, templates, library):
    """Every template at every beginning that words of both posted halves agree on: ``(label, start, share, whether a key phrase is whole)``."""
    w = license_words(text)
    out = []
    for (name, _, _), (words, posts, keys) in zip(templates, library, strict=True):
        first, second = ({i - at for at in half for i, x in enumerate(w) if x == words[at]} for half in posts)
        for start in first & second:
            ok = [0 <= start + k < len(w) and w[start + k] == x for k, x in enumerate(words)]
            out.append((name, start, sum(ok) / len(ok), any(all(ok[a : a + n]) for a, n in keys)))
    return out


def marginals(e, chain):
    """P(state 1) of each place, by summing over all sequences."""
    n = len(e)
    total, ones = 0.0, [0.0] * n
    for s in range(2**n):
        bits = [s >> k & 1 for k in range(n)]
        weight = math.exp(sum(x for x, b in zip(e, bits, strict=True) if b) + sum(chain[a][b] for a, b in zip(bits, bits[1:], strict=False)))
        total += weight
        for k, b in enumerate(bits):
            ones[k] += weight * b
    return [x / total for x in ones]


def normal(text):
    return unicodedata.normalize("NFC", text)
