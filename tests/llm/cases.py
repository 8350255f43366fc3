"""Small documents with every awkward case: nulls, blanks, ties, repeated rows, long texts, copies and leaks."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, size string, fp string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeñéß") for _ in range(rng.randint(2, 9))) for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    base = [words(rng, 120) for _ in range(12)]
    texts = [*base, base[0], base[0], base[1] + " tail", base[2].replace(" ", "\n", 5), base[3][:150] + "X" + base[3][150:]]
    passage = words(rng, 60)
    texts += [words(rng, 30) + "\n" + passage + "\n" + words(rng, 30) for _ in range(4)]
    texts += [None, "", " \n\t ", "one", "one two three", "a b c d e", "ab " * 300, "x" * 900, "Ünï " * 80, "line one\nline one\n\nline two\nline one", " nbsp em space", "a\x0bb\x0cc\rd"]
    texts += [words(rng, 3000), " ".join(["# $ % & | < > *"] * 20), words(rng, 40).upper()]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base[4], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
