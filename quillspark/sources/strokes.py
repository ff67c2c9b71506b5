"""Binary pages of versions 3 and 5, and the text of HTML and of EPUB books; one file at a time, in Arrow batches."""

from __future__ import annotations

import io
import re
import struct
import sys
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

#: The numbers of pens.
PENS = {0: "brush", 12: "brush", 21: "calligraphy", 3: "marker", 16: "marker", 2: "ballpoint", 15: "ballpoint", 4: "fineliner", 17: "fineliner", 1: "pencil", 14: "pencil", 7: "mechanical_pencil", 13: "mechanical_pencil", 5: "highlighter", 18: "highlighter", 8: "erase_area", 6: "eraser"}
HEADER = 43
STROKES = "path string, layer int, stroke int, pen string, colour int, width double, xs array<double>, ys array<double>, pressures array<double>"


def version(content: bytes) -> int | None:
    found = re.match(rb"reMarkable \.lines file, version=(\d+)", content[:HEADER])
    return int(found[1]) if found else None


def parse(content: bytes | None) -> list[tuple]:
    """(layer, stroke, pen, colour, width, xs, ys, pressures); none where the page is of another version, cut short or without layers."""
    which = version(content or b"")
    if which not in (3, 5) or len(content) < HEADER + 4:
        return []
    head = struct.Struct("<IIIffI" if which == 5 else "<IIIfI")
    at, out = HEADER + 4, []
    try:
        for layer in range(struct.unpack_from("<I", content, HEADER)[0]):
            (count,) = struct.unpack_from("<I", content, at)
            at += 4
            for stroke in range(count):
                pen, colour, _, width, *_, n = head.unpack_from(content, at)
                at += head.size
                points = list(struct.iter_unpack("<6f", content[at : at + 24 * n]))
                if len(points) < n:
                    return []
                at += 24 * n
                out.append((layer, stroke, PENS.get(pen, "pen"), colour, width, [p[0] for p in points], [p[1] for p in points], [p[5] for p in points]))
    except struct.error:
        return []
    return out


def read_strokes(files: DataFrame) -> DataFrame:
    """A row for each stroke of files (path, content)."""
    columns = [x.split()[0] for x in STROKES.split(", ")]

    def run(batches):
        for b in batches:
            rows = [(path, *s) for path, content in zip(b["path"], b["content"], strict=True) for s in parse(content)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, STROKES)


def polyline(xs: list[float], ys: list[float], colour: str = "black", width: float = 1.0) -> str:
    points = " ".join(f"{x:.3f},{y:.3f}" for x, y in zip(xs, ys, strict=True))
    return f'<polyline style="fill:none;stroke:{colour};stroke-width:{width:.3f}" points="{points}"/>'


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> str:
    """Without scripts and styles; pieces of trimmed lines between double spaces, joined by one. Null: empty."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (line.strip() for line in "".join(parser.parts).splitlines())
    return " ".join(piece.strip() for line in lines for piece in line.split("  ") if piece.strip())


def epub_text(content: bytes | None) -> str | None:
    """All documents of the book, in the order of the archive; null where it is no archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
            return " ".join(html_text(book.read(n).decode("utf-8", "replace")) for n in book.namelist() if re.search(r"\.x?html?$", n, re.I))
    except zipfile.BadZipFile:
        return None


def epub_cover(content: bytes | None, least: int = 10_000) -> str | None:
    """The name of the cover: a file called cover, else the one that the package names, else the largest image over ``least`` bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as book:
            names = book.namelist()
            for n in names:
                if re.fullmatch(r"cover\.(jpg|jpeg|png|gif)", n.rsplit("/", 1)[-1], re.I):
                    return n
            for n in (x for x in names if x.endswith(".opf")):
                opf = book.read(n).decode("utf-8", "replace")
                wanted = re.search(r"<meta[^>]*name=[\"']cover[\"'][^>]*content=[\"']([^\"']+)", opf)
                items = [x for x in re.findall(r"<item\b[^>]*>", opf) if wanted and re.search(rf"\bid=[\"']{re.escape(wanted[1])}[\"']", x)]
                href = re.search(r"href=[\"']([^\"']+)", items[0]) if items else None
                if href:
                    return next((x for x in names if x.endswith(href[1])), None)
            sizes = [(i.file_size, i.filename) for i in book.infolist() if re.search(r"\.(jpg|jpeg|png|gif)$", i.filename, re.I) and i.file_size > least]
            return max(sizes)[1] if sizes else None
    except zipfile.BadZipFile:
        return None


def with_html_text(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and text."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": b[html].map(html_text)})

    return df.select(key, html).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def books(files: DataFrame) -> DataFrame:
    """path, text and cover of EPUB files (path, content)."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": b["content"].map(epub_text), "cover": b["content"].map(epub_cover)})

    return files.select("path", "content").mapInPandas(run, "path string, text string, cover string")
