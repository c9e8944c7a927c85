"""Rows and brute-force versions that the tests of this folder share."""

import random

WORDS = "the of and river stone light window garden morning table engine letter winter music shadow market bridge paper ocean forest".split()


def prose(n, seed, extra=()):
    r = random.Random(seed)
    return " ".join(r.choice([*WORDS, *extra]) + str(r.randrange(50)) for _ in range(n))


def documents(spark, rows):
    """Documents with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, set_id string, h string, links string, score string, spans string, root string, row string, at string, rule string"
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), *["x"] * 9) for i, t in rows], schema)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text, n=5):
    words = "".join(c if ord(c) > 32 else " " for c in (text or "").lower()).split(" ")
    words = [w for w in words if w]
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0
