"""Small documents with copies, near copies, junk, personal data and odd cases."""

import random

SYLLABLES = "ba de fi go hu ka le mi no pu ra se ti vo".split()
BAD = ("grubbish", "snarkface", "vilthon")


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def documents(seed=1, n=60):
    """Rows ``(doc_id, text, lang, source, n_chars)``."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(55, 160)) for _ in range(n)]
    for k in range(10):  # copies with nothing, one and a few words changed
        base = texts[k].split()
        texts.append(" ".join(base))
        base[rng.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
        for _ in range(8):
            base[rng.randrange(len(base))] = word(rng)
        texts.append(" ".join(base))
    texts += ["", None, "   \n", "one", "One two three", "one TWO three", "a b c d e", "a b c d e f", "###%%% " * 60 + prose(rng, 60), "say it again " * 40, "HELLO!! " * 70]
    texts += [prose(rng, 70) + " mail me at joe.x@mail.example.org or +1 (555) 010-2030, card 4111111111111111 " + prose(rng, 5)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("id", "n", "key", "rep", "sig", "component", "kept", "score", "rank", "h", "c", "row", "spans", "label2", "size", "offset", "sequence_id", "_row", "_text")})
