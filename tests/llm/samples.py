"""Small tables with everything that an operator must take: nulls, empty and long texts, copies, repeated rows, extra columns."""

import random

LETTERS = "abcdefghij"


def prose(rng, words, vocabulary=400):
    return " ".join(f"{LETTERS[v % 10]}{v}{LETTERS[v // 10 % 10]}" for v in (rng.randrange(vocabulary) for _ in range(words)))


def changed(rng, text, share):
    out = [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split(" ")]
    return " ".join(out)


def documents(seed=7):
    """(doc_id, text, source): about 120 rows."""
    rng = random.Random(seed)
    passage, other = prose(rng, 80), prose(rng, 60)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(40)]
    texts += [texts[0]] * 5 + [changed(rng, texts[i], s) for i in (1, 2, 3, 4) for s in (0.01, 0.03, 0.1)]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)] + [f"{passage}\n\t{other}", f"{other}  {passage}", other]
    texts += [None, "", " \t\n ", "one", "Two words", "THREE Words here", "ein wort mehr ä ö ü ß 漢字 😀", "a" * 5000, "ab " * 900, prose(rng, 6000, 3000), "rep eat " * 150 + prose(rng, 40), "<|endoftext|> x <|endoftext|>", "\x00\x1c \x85   z"]
    rows = [(i * 3 + 1, t, f"src{i % 5}" if i % 11 else None) for i, t in enumerate(texts)]
    rows += [(10_001, texts[2], "src1"), (10_001, texts[2], "src1")]
    return rows


def frame(spark, rows=None, extra=False):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long")
    if extra:
        for name in ("print", "key", "n", "span", "core", "size", "path", "_id", "_slot", "_size", "_copy", "_copies", "_whole", "_windows", "_host", "_path", "_first"):
            df = df.selectExpr("*", f"'extra' AS `{name}`")
    return df.repartition(3)


def empty(spark):
    return frame(spark, []).coalesce(1)
