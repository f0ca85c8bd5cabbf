"""Small document tables for the operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd: random.Random, words: int, vocabulary: int = 400) -> str:
    parts = ["ther", "an", "ding", "ol", "é", "ses", "ti", "mor", "ка", "wen"]
    vocab = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(vocabulary)]
    return " ".join(rnd.choice(vocab) + rnd.choice(["", "", "", ",", ".", "\n"]) for _ in range(words))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["key", "start", "strings", "anchor", "repeats", "fp", "root", "score", "predicted", "c0", "c1", "length", "salt", "cell", "shard", "__a", "__b", "c7"]
    return docs.withColumns({n: F.lit(7) for n in names})


def odd_texts(seed: int = 3) -> list:
    """Nulls, empty, white space, repeats, control strings, one very long word and one long text."""
    rnd = random.Random(seed)
    a, b = prose(rnd, 120), prose(rnd, 90)
    return [None, "", " ", "\n\n", "x", a, a, a + " tail", b, "é" * 300, "ab" * 400, b + "\n" + a, prose(rnd, 6000),
            "<|im_start|>x<|endoftext|>", "Z" * 3000, " a b 'll 's", None, ""]
