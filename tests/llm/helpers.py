"""Small inputs shared by the tests of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOCS + ", kind string, key string, _row string, _hits string, score string, label string, `odd name` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = ["alpha", "beta", "Gamma", "delta", "été", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "Omicron", "pi"]


def prose(seed, n, vocab=VOCAB):
    r = random.Random(seed)
    return " ".join(r.choice(vocab) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def wide_prose(seed, n):
    """Words that hardly repeat by chance."""
    r = random.Random(seed)
    return " ".join("w%06x" % r.randrange(1 << 20) for _ in range(n))


def row(i, text, lang="en", source="s", n_chars=0):
    return (i, text, lang, source, n_chars)


def messy():
    """Null and empty texts, null ids, repeated rows and ids, ties, a very long text, odd white space."""
    long = wide_prose(99, 30_000)
    return [row(1, None), row(2, ""), row(3, " \n\t "), row(4, "one"), row(5, "one two three"), row(5, "one two three"),
            row(None, "no id at all here"), row(6, prose(6, 80)), row(7, prose(6, 80)), row(7, prose(7, 80)), row(8, long, None, None, None),
            row(9, "A B c　d\x0be\x0cf\r\ng"), row(10, "x" * 5000 + " y"), row(11, prose(6, 80) + " tail"), row(-3, "\x00 nul \U0001F600 İıſK")]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows], CLASH)


def words(text):
    return (text or "").encode().split()
