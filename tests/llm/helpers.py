"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, shard int, rank long"


def regular(n: int = 10) -> tuple[str, str]:
    """Two different strings of 2**n letters whose sums of powers of an odd number are equal modulo 2**64."""
    one, two = "a", "b"
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9))) for _ in range(n))


def documents(spark, texts, first=0):
    """texts: strings or None, in order of doc_id; with columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t), 7, 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def awkward(spark):
    base = prose(1, 300)
    texts = [base, base, base.replace("a", "b", 2), None, "", " \n\t ", "x", "one two", prose(2, 30000), prose(3, 200) + " " + base[:700], "Ünï çødé \U0001f600 text with rare spaces\x1cand controls", "it's  two   spaces\n\n\nand lines \n", prose(4, 120)]
    df = documents(spark, texts)
    extra = spark.createDataFrame([(None, "no id", None, None, None, 1, 1, 1), (0, base, "en", "src0", len(base), 7, 7, 7)], DOCS)
    return df.unionByName(extra)


def empty(spark):
    return spark.createDataFrame([], DOCS)
