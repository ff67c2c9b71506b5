"""Words, forms and roots against plain Python: edits of every word, looked up among all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillspark.llm import spelling
from quillspark.llm.common import work_dir

from .helpers import awkward, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, one_in=97, least_letters=5, least_times=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_times}


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def plain(words):
    letters, near, form = set("".join(words)), {}, {}
    for w in words:
        near[w] = edits(w, letters) & words.keys()
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def alike(n):
    """Words of few letters, so that most have many neighbours, some under a long common beginning or end."""
    rng = random.Random(n)
    words = ["".join(rng.choices("abç", k=rng.randint(4, 8))) for _ in range(n)]
    words += ["commonbeginning" + "".join(rng.choices("ab", k=6)) for _ in range(n)] + ["".join(rng.choices("xy", k=6)) + "ending" for _ in range(n)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "Ünder", "ünder", "UNDER", "under", "a×b÷cde"] * 3
    return [" ".join(rng.choices(words, k=3 * n)) + "." for _ in range(6)]


CASES = {
    "alike": lambda s: documents(s, alike(150)),
    "awkward": awkward,
    "empty": empty,
    "table": lambda s: s.read.parquet("/root/testdata/sf0.001/documents.parquet"),
    "long": lambda s: documents(s, ["q" * 70000 + " " + "q" * 69999, "q" * 70000, "q" * 70000 + "é" * 300, "é" * 300 + " " + "é" * 299 + "e", None] * 3),
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("most", [8, 512])
def test_variants(spark, kind, most):
    docs = CASES[kind](spark)
    got = [tuple(r) for r in spelling.variants(docs, work_dir(spark, "t13"), most=most).collect()]
    words = counted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(got) == len(set(got))
    if kind == "long":  # edits of the longest words are too many for plain Python
        assert {(r[0], r[3]) for r in got} == set(words.items())
        assert {(len(r[0]), len(r[1] or ""), r[4]) for r in got if len(r[0]) > 1000} >= {(69999, 70000, 1), (70000, 0, 1)}
        return
    assert set(got) == plain(words)


def test_checksums_and_flushes(spark):
    rows = [(i, t) for i, t in enumerate(alike(40) + ["x" * 64 + " " + "y" * 65 + " " + "é" * 32 + " " + "é" * 33])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for one_in in (0, 1, 3):
        assert {tuple(r) for r in spelling.vocabulary(docs, 1, 1, one_in, held=20).collect()} == {(w, n) for w, n in counted(rows, one_in, 1, 1).items()}


def test_each_pair_once(spark):
    words = spark.createDataFrame([(w, n) for w, n in counted([(1, x) for x in alike(80)]).items()], "word string, n long")
    found = [(r.word, r.other) for r in spelling.all_links(words, work_dir(spark, "t13"), most=8).collect()]
    assert len(found) == len(set(found)) and {(b, a) for a, b in found} == set(found)
