"""Small fixtures and brute-force versions for the operators' tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def shingle_set(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def documents(spark, texts, **more):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def prose(seed, n):
    """``n`` words that differ from seed to seed."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


ODD = [None, "", "   \n\t ", "a", "a", "x" * 50_000, "word " * 20_000, "é ß 東京   x́", "don't 12 *** <|endoftext|>"]
