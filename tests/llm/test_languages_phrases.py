"""Language identification and collocations against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import kernel as K
from corvane.llm import langid, phrases
from tests.llm.data import clashing

TONGUES = {"xa": "ba de fi go hu ka".split(), "xb": "ne pi ro su ta vo".split(), "xc": "schü räd ömpf lüg wäch".split()}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.choice((1, 2, 2, 5)))) for _ in range(n))


def corpus(seed, per=25):
    rng = random.Random(seed)
    return [(lang, tongue(rng, lang, rng.randint(5, 60))) for lang in TONGUES for _ in range(per)]


def words_of(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def brute_model(rows):
    """The tables of the operator, in dictionaries: words and n-grams by language, with logarithms."""
    docs = {lang: {t for x, t in rows if x == lang} for lang in {x for x, _ in rows}}
    count, found = defaultdict(Counter), defaultdict(Counter)
    for lang, texts in docs.items():
        for t in texts:
            count[lang].update(words_of(t))
            found[lang].update(set(words_of(t)))
    langs = sorted(docs, key=lambda x: (-count[x].total(), x))

    def logs(tables):
        total = {x: sum(tables[x].values()) for x in langs}
        least = -math.log10(max(total.values())) - langid.PENALTY
        return {k: [math.log10(tables[x][k] / total[x]) if tables[x][k] else least for x in langs] for k in set().union(*tables.values())}

    known = {x: Counter({w: c for w, c in count[x].items() if found[x][w] >= langid.KNOWN_DOCS}) for x in langs}
    grams = []
    for size in range(1, langid.LONGEST + 1):
        tables = {x: Counter() for x in langs}
        for x in langs:
            for w, c in count[x].items():
                for g in grams_of(w, size):
                    tables[x][g] += c
        grams.append(logs(tables))
    return langs, logs(known), grams


def grams_of(w, size):
    p = f" {w} "
    return [p[i : i + size] for i in range(len(p) - size + 1) if p[i : i + size] != " "]


def brute_predict(model, text):
    langs, known, grams = model
    ws = words_of(text)
    if not ws:
        return "und", 0.0
    rows = []
    for w in ws:
        if w in known:
            rows.append(known[w])
            continue
        for size in range(langid.LONGEST, 0, -1):
            hit = [grams[size - 1][g] for g in grams_of(w, size) if g in grams[size - 1]]
            if hit:
                rows.append([sum(x) / len(hit) for x in zip(*hit, strict=True)])
                break
        else:
            rows.append([0.0] * len(langs))
    mean = [sum(x) / len(rows) for x in zip(*rows, strict=True)]
    top = max(mean)
    return langs[mean.index(top)], 1 / sum(10 ** ((m - top) * math.sqrt(len(ws))) for m in mean)


def test_language_equals_brute_force(spark):
    train = corpus(3)
    model = langid.learn(spark.createDataFrame(train, "lang string, text string"))
    brute = brute_model(train)
    texts = [t for _, t in corpus(4, 8)] + ["ba", "bade RÄDschü!", "zzz", "1 2 3", "", None, "ne-pi, ro\tgo", "qqba", "РАЗ два", "ba" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predicted(rows, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        lang, score = brute_predict(brute, t)
        assert got[i]["lang_pred"] == lang, t
        assert got[i]["score"] == pytest.approx(score, abs=1e-4)


def test_language_backs_off_step_by_step():
    word, n = pa.array(["abc", "abd", "xyz"]), np.array([4, 1, 3])
    model = langid.fit(["p", "p", "q"], word, n, np.array([2, 1, 2]))
    assert model.langs == ["p", "q"]
    logs, known = langid.word_logs(model, pa.array(["abc", "abd", "abx", "zzz", "ж"]))
    assert known.tolist() == [True, False, False, False, False]
    assert logs[1, 0] > logs[1, 1] and logs[2, 0] > logs[2, 1] and logs[3, 1] > logs[3, 0]
    assert logs[4].tolist() == [0, 0]


def test_language_odd_cases(spark):
    train = corpus(5)
    docs = spark.createDataFrame(train + train[:7] + [(None, "ne pi"), ("xd", None), ("xe", "")], "lang string, text string")
    model = langid.learn(docs)
    assert sorted(model.langs) == ["xa", "xb", "xc"]
    again = langid.learn(docs.repartition(7))
    assert again.langs == model.langs and np.array_equal(again.words.keys, model.words.keys) and np.array_equal(again.words.logs, model.words.logs)
    rows = clashing(spark.createDataFrame([(1, "ba de fi"), (1, "ba de fi"), (None, "ne pi ro"), (2, None), (3, "4 5"), (4, "́")], "doc_id long, text string"))
    out = [(r["doc_id"], r["lang_pred"]) for r in langid.predicted(rows, model).collect()]
    assert sorted(out, key=str) == [(1, "xa"), (1, "xa"), (2, "und"), (3, "und"), (4, "und"), (None, "xb")]
    assert langid.predicted(rows.limit(0), model).count() == 0
    none = langid.learn(docs.limit(0))
    assert none.langs == []
    assert {(r["lang_pred"], r["score"]) for r in langid.predicted(rows, none).collect()} == {("und", 0.0)}


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_DOCS", 3)
    rows = [("en", f"w{i} only{i}") for i in range(40)]
    sample = langid._sample(spark.createDataFrame(rows, "lang string, text string"), langid.Scratch(spark, "t"), "text", "lang").collect()
    assert len(sample) == 3


def test_language_held_out(spark):
    from corvane.llm.queries import op11_langid

    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = op11_langid(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and held
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


# --- collocations ---


def split_pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_collocations(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in split_pieces(text):
            total[lang] += len(p)
            for s in range(1, 6):
                counts[lang].update(tuple(p[i : i + s]) for i in range(len(p) - s + 1))
    out = []
    for lang, c in counts.items():
        best = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items() if b >= least):
                continue
            s, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for i, x in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=80):
    rng = random.Random(seed)
    few = ["der", "Haus", "und", "Ä", "zz", "été"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(few) if rng.random() < 0.7 else rng.choice(["the cat sat on the mat", "éa b", "a a a a", "x\x00y"]) for _ in range(rng.randint(0, 25))]
        rows.append(("".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", "\x85 "]) for p in parts), rng.choice(["en", "en", "de", None])))
    return rows + [("", "en"), (None, "en"), (None, None), (" ,;", "fr"), ("one", "fr"), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize(("least", "top"), [(3, 1000), (10, 7)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(phrases, "SHARD", 300)
    rows = phrase_rows(least)
    docs = clashing(spark.createDataFrame(rows, "text string, lang string")).repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, top=top).collect())
    assert got == brute_collocations(rows, least, top) and got


def test_collocations_with_a_saturated_filter(spark, monkeypatch):
    """The bitmap only spares work: with few bits, which let nearly everything pass, the result is the same."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    rows = phrase_rows(9)
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5).collect())
    assert got == brute_collocations(rows, 5, phrases.TOP)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("a b c", "en")], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_collocation_products_pass_64_bits(spark):
    big = 3_000_000_000_000
    grams = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 7 * big)], "lang string, words long")
    r = phrases.scores(grams, totals).first()
    assert r["score"] == 1000 * big * 7 * big // (big * (big + 1))


def classical(sequences):
    """The textbook online automaton of several sequences: endpos counts of all its substrings by walking it."""
    nxt, link, length, count = [{}], [-1], [0], [0]

    def clone(p, c, q):
        r = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        count.append(0)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = r
            p = link[p]
        link[q] = r
        return r

    for s in sequences:
        last = 0
        for c in s:
            if c in nxt[last]:
                q = nxt[last][c]
                last = q if length[q] == length[last] + 1 else clone(last, c, q)
                count[last] += 1
                continue
            cur, p = len(nxt), last
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(1)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else clone(p, c, q)
            last = cur
    for v in sorted(range(1, len(nxt)), key=lambda v: -length[v]):
        if link[v] > 0:
            count[link[v]] += count[v]
    return nxt, count, link, length


def test_automaton_equals_the_classical_one():
    rng = random.Random(2)
    for _ in range(30):
        seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        word = np.array([c for s in seqs for c in s], np.int64)
        joined = np.array([j + 1 < len(s) for s in seqs for j in range(len(s))])
        levels = phrases.automaton(word, joined, 4)
        nxt, count, link, length = classical(seqs)
        state = lambda s: (lambda v: [v := nxt[v][c] for c in s][-1])(0)
        seen = {}
        for size, level in enumerate(levels, 1):
            for i, (n, at) in enumerate(zip(level.count.tolist(), level.at.tolist(), strict=True)):
                s = tuple(word[at - size + 1 : at + 1].tolist())
                v = state(s)
                assert n == count[v]
                seen[size, i] = s
                if size > 1:  # the link leads to the suffix, and both share a state if they end at the same places
                    up = seen[size - 1, level.link[i]]
                    assert up == s[1:]
                    assert (state(up) == v) == (levels[size - 2].count[level.link[i]] == n)
        assert sum(len(x.at) for x in levels) == len({tuple(s[i : i + k]) for s in seqs for k in range(1, 5) for i in range(len(s) - k + 1)})


def test_pieces_keep_words_apart():
    run = next(K.runs(pa.array(["A b.c\n", "d\te  f\n"])))
    p = phrases.pieces(run, np.array([0, 1]), 2)
    assert [p.buf[a:b].tobytes() for a, b in zip(p.start, p.end, strict=True)] == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert p.joined.tolist() == [True, False, False, True, True, False]
    assert p.buf[p.start[3] : p.end[5]].tobytes() == b"d e f"


def test_words_count_for_the_whole_language(spark):
    docs = spark.createDataFrame([("a b. a b", "en"), ("rare", "en")], "text string, lang string")
    r = phrases.collocations(docs, least=2).filter(F.col("lang") == "en").first()
    assert (r["phrase"], r["a"], r["n"], r["score"]) == ("a b", 2, 5, 2500)
