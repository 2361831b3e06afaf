"""Small tables with awkward rows, and plain versions of what operators compute."""

import random
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = ["the", "of", "and", "red", "fox", "runs", "über", "ñandú", "x", "word", "tion", "ing", "line", "Tree", "a", "é"]


def prose(rng, n):
    return " ".join(rng.choice(STEMS) + rng.choice(["", "", "s", "ly", ".", ","]) for _ in range(n))


def corpus(n=120, seed=1):
    """Texts with copies, near copies, repeats, and odd ones; null in every column somewhere."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 3, 4, 5, 12, 60, 200]))
        if i % 9 == 1 and rows:
            text = rows[-1][1]
        if i % 11 == 3 and rows and rows[-1][1]:
            w = rows[-1][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        if i % 13 == 5:
            text = "\n".join([text, text, "", text])
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "Z", None]), None if i % 5 else len(text)))
    odd = [None, "", " \t\n", " ", "  x \u0085", "one", "Two words", "A\x00b c", "🙂 " * 30, "word " * 20_000, "9" * 3000, "..., !!"]
    return rows + [(n + i, t, "en", "s1", 0) for i, t in enumerate(odd)]


def frame(spark, rows, extra=True):
    """The rows as documents, over several partitions; with columns whose names operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        for name in ("size", "key", "u", "v", "row", "n", "family", "words", "kept", "score"):
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())
