"""Windows, pages and books against plain Python that scores every window."""

import random
import re

import pytest

from quillspark.operators import matching, windows

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("etaoinshrdlué", k=RNG.randint(1, 9))) for _ in range(250)]


def prose(rng, n):
    return " ".join(w + rng.choice([".", "!", '."', ",", "", "", "", ""]) for w in rng.choices(VOCABULARY, k=n))


def misread(rng, text, share):
    return " ".join("".join(rng.choice("etaoinshr ") if rng.random() < share else c for c in text if rng.random() > share / 3).split())


def every_window(needle, text, threshold, longer):
    words, n = text.split(), len(needle.split())
    best = (0, 0, 0)
    for size, measure in [(n, windows.ratio), *[(n + more, windows.partial_ratio) for more in longer]]:
        if size == n + longer[0] and best[0] >= threshold:
            break
        for i in range(len(words) - size + 1):
            score = measure(needle, " ".join(words[i : i + size]))
            if score > best[0]:
                best = (score, i, i + size)
    return best if best[0] >= threshold else (0, 0, 0)


def cases(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words = prose(rng, rng.choice([1, 3, 20, 60, 120])).lower().split()
        k = min(len(words), rng.choice([1, 2, 4, 9, 20]))
        at = rng.randrange(len(words) - k + 1)
        needle = misread(rng, " ".join(words[at : at + k]), rng.choice([0.05, 0.1, 0.2, 0.3]))
        if i % 5 == 0:
            needle = prose(rng, k).lower()
        if i % 7 == 0:
            needle = needle[: len(needle) * 2 // 3].strip() + "x"
        if needle:
            yield needle, " ".join(words), rng.choice([65, 75, 85])


@pytest.mark.parametrize("seed", range(3))
def test_best_window_is_that_of_all(seed):
    for needle, text, threshold in cases(80, seed):
        got = windows.best(needle, text, threshold, (5, 10, 20))
        if needle in text:
            assert got.exact and got.score == 100 and text[got.start : got.end] == needle
            continue
        assert (got.score, got.first, got.last) == every_window(needle, text, threshold, (5, 10, 20))
        assert not got.score or text[got.start : got.end].split() == text.split()[got.first : got.last]


def test_few_windows_are_scored():
    """500 needles over a whole book: the best window of each is found, and at most 2 % of the windows are scored."""
    rng = random.Random(9)
    book = prose(rng, 6000).lower()
    words, all_, scored = book.split(), 0, 0
    for _ in range(500):
        at = rng.randrange(len(words) - 12)
        own = " ".join(words[at : at + 12])
        needle = own.replace("e", "c", 3)[:-1] + "q"
        got = windows.best(needle, book, 85)
        assert got.score >= 85 and windows.ratio(needle, book[got.start : got.end]) == got.score >= windows.ratio(needle, own)
        all_, scored = all_ + got.windows, scored + got.verified
    assert all_ > 2_000_000 and scored <= 0.02 * all_


def test_long_and_odd_needles():
    rng = random.Random(2)
    text = prose(rng, 400).lower()
    long = misread(rng, text[:1500], 0.05)
    assert windows.best(long, text, 65).score >= 65
    assert windows.best("", text, 65).score == windows.best("a b", "", 65).score == 0
    assert windows.best("\ud800 é 😀", "x \ud800 é 😁 y", 65).score >= 65
    assert windows.best("a b c d e f g h", "a b", 10).windows == 0


@pytest.mark.parametrize("seed", range(3, 6))
def test_strands_give_the_windows_of_all(seed):
    """Scored by strands, pairs of all lengths combed together."""
    all_ = list(cases(80, seed))
    odd = [("a b", "", 65), ("\ud800 é 😀", "x \ud800 é 😁 y", 65), ("a b c d e f g h", "a b", 65), ("abcdefgh ijklmnop", "a b c d e f g h i j k l m n", 65)]
    combed = windows.strands([(needle, text) for needle, text, _ in [*all_, *odd]])
    for (needle, text, threshold), stops in zip([*all_, *odd], combed, strict=True):
        got, want = windows.best(needle, text, threshold, (5, 10, 20), stops=stops), windows.best(needle, text, threshold, (5, 10, 20))
        assert (got.score, got.start, got.end, got.first, got.last, got.longer, got.windows) == (want.score, want.start, want.end, want.first, want.last, want.longer, want.windows)
        if needle not in text:
            assert (got.score, got.first, got.last) == every_window(needle, text, threshold, (5, 10, 20))


def test_strands_count_common_subsequences():
    rng = random.Random(4)
    pairs = [("".join(rng.choices("abcd ", k=rng.randint(1, 150))), "".join(rng.choices("abcde ", k=rng.randint(1, 300)))) for _ in range(40)]
    for (needle, text), stops in zip(pairs, windows.strands(pairs), strict=True):
        for _ in range(30):
            a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
            assert (stops[a:b] >= b).sum() == windows.common_subsequence(needle, text[a:b])


def test_found_text_is_the_page_s_own():
    """Blanks and capitals of the page stay, and so does the place of each pair when more than TOGETHER are combed."""
    pairs = [(f"thc cat numbcr {i} sat", f"A dog.  The Cat number {i} sat.\nEnd {i}.") for i in range(matching.TOGETHER + 5)]
    got = matching.located_all(*zip(*pairs, strict=True), 65)
    assert [x[1] for x in got] == [f"The Cat number {i} sat." for i in range(len(pairs))] and got[-1] == matching.located(*pairs[-1], 65)


def plain_pages(highlights, pages):
    texts = {(b, p): t for b, p, t in pages}
    out = {}
    for id_, book, page, needle in highlights:
        for p in (page, page + 1, page - 1, page + 2, page - 2) if page and page > 0 else ():
            score, found = plain_match(needle, texts.get((book, p)))
            if found is not None:
                out[id_] = (p, score, found)
                break
    return out


def plain_match(needle, text, threshold=65):
    n, t = (" ".join((x or "").split()).lower() for x in (needle, text))
    if not n or not t:
        return 0, None
    if n in t:
        return 100, text[t.index(n) : t.index(n) + len(n)]
    score, first, last = every_window(n, t, threshold, (5, 10))
    return (score, text[slice(*matching.to_sentence(text, *matching.word_span(text, first, last)))]) if score else (0, None)


def test_pages(spark):
    rng = random.Random(3)
    pages = [(b, p, prose(rng, rng.choice([5, 40, 60]))) for b in ("a", "b") for p in range(1, 9)] + [("a", 9, None), ("c", 1, "")]
    highlights = [(i, b, p + rng.choice([-2, -1, 0, 0, 1, 3]), misread(rng, " ".join((t or "x").split()[2:14]), 0.08)) for i, (b, p, t) in enumerate(pages * 2)]
    highlights += [(100, "a", None, "text"), (101, "a", 0, "text"), (102, None, 3, "text"), (103, "a", 3, None), (104, "a", 3, ""), (105, "z", 1, "text")]
    got = matching.page_search(spark.createDataFrame(highlights, "id int, book string, page_number int, text string"), spark.createDataFrame(pages, "book string, page_number int, text string"), "book").collect()
    assert {r.id: (r.page, r.score, r.found) for r in got} == plain_pages(highlights, pages) and len(got) > 15
    texts = {(b, p): t for b, p, t in pages}
    books = {h[0]: h[1] for h in highlights}
    assert all(texts[books[r.id], r.page][r.start : r.end] == r.found and r.verified <= r.windows for r in got)


@pytest.mark.parametrize("threshold", [65, 85])
def test_parts_share_their_strands(threshold):
    """Combed once for all levels, a segment has what it has without strands."""
    rng = random.Random(threshold)
    size, reach, rows = 500, 400, []
    for _ in range(40):
        text = prose(rng, rng.choice([40, 150, 400]))
        words, segment = text.split(), rng.randrange(max(1, len(text) // 500))
        at, base = rng.randrange(len(words)), max(0, segment * size - matching.CONTEXT)
        needle = misread(rng, " ".join(words[at : at + 8]), 0.1).lower() or "x"
        rows.append((needle, at / len(words), segment, base, len(text), text[base : segment * size + size + reach + matching.CONTEXT]))
    got = matching.in_segments(rows, size, reach, threshold)
    for (needle, at, segment, base, length, text), found in zip(rows, got, strict=True):
        lower = matching.lowered(text)
        want = matching.in_segment(needle, matching.parts(at, segment, base, length, lower, size, reach), segment, base, text, lower, size, threshold)
        assert [x[:-1] for x in found] == [x[:-1] for x in want]
    assert sum(x[1] < 3 for found in got for x in found) > 10


def plain_book(needle, book, page, pages, threshold):
    """All windows of the whole words in each part of the book."""
    n, text = " ".join(needle.split()), " ".join(book.split())
    own = matching.lowered(n)
    for window in matching.LEVELS:
        x, y = matching.about(page / pages, len(text), window)
        spans = [m.span() for m in re.finditer(r"\S+", text) if x <= m.start() and m.end() <= y]
        if not spans:
            continue
        low, high = spans[0][0], spans[-1][1]
        part = matching.lowered(text[low:high])
        if own in part:
            start = low + part.index(own)
            end = start + len(own)
            score, found = 100, text[start:end]
        else:
            score, first, last = every_window(own, part, threshold, (5, 10, 20))
            if not score:
                continue
            start, end = spans[first][0], spans[last - 1][1]
            near = max(0, start - matching.CONTEXT)
            a, b = matching.to_sentence(text[near : end + matching.CONTEXT], start - near, end - near)
            found = text[near + a : near + b]
        if windows.ratio(n[:100].lower(), found[:100].lower()) >= 70:
            return score, found, start, end
    return None


@pytest.mark.parametrize(("size", "reach", "threshold"), [(400, 700, 85), (300, 200, 65), (4096, 4096, 65)])
def test_books(spark, size, reach, threshold):
    rng = random.Random(size)
    books = {"a": prose(rng, 700), "b": prose(rng, 90), "c": "", "d": None}
    highlights = []
    for i in range(40):
        book = rng.choice("aaab")
        words = books[book].split()
        at, k = rng.randrange(len(words)), rng.choice([3, 8, 8, 25])
        text = misread(rng, " ".join(words[at : at + k]), rng.choice([0, 0.04, 0.1])) or "x"
        highlights.append((i, book, max(1, round(100 * at / len(words)) + rng.choice([-9, -4, 0, 0, 4, 30])), 100, text))
    highlights += [(90, "c", 1, 2, "text"), (91, "d", 1, 2, "text"), (92, "a", 0, 2, "text"), (93, "a", 1, None, "text"), (94, "a", 50, 100, None), (95, "a", 50, 100, " ")]
    frame = spark.createDataFrame(highlights, "id int, book string, page_number int, pages int, text string")
    got = matching.book_search(frame, spark.createDataFrame(list(books.items()), "book string, text string"), "book", threshold, size, reach).collect()
    want = {i: plain_book(t, books[b], p, n, threshold) for i, b, p, n, t in highlights if t and t.strip() and p and n and books.get(b)}
    assert {r.id: (r.score, r.found, r.start, r.end) for r in got} == {k: v for k, v in want.items() if v} and len(got) > 8
