"""Pages of strokes as SVG: a polyline for each few points of a stroke, with the width, shade and opacity that its pen has there."""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from quillspark.sources.strokes import HEADER, PENS, version

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have this package

#: A page's size, and the colours by number.
WIDTH, HEIGHT = 1404, 1872
BYTES = 16 << 20  # of pages drawn at once
COLOURS = {0: (0, 0, 0), 1: (125, 125, 125), 2: (255, 255, 255), 3: (251, 247, 25)}


@dataclass
class Points:
    """One value a point."""

    x: np.ndarray
    y: np.ndarray
    speed: np.ndarray
    tilt: np.ndarray
    width: np.ndarray
    pressure: np.ndarray


Of = Callable[[Points, float], np.ndarray]


@dataclass
class Pen:
    """every: points a polyline; base: the stroke's width from the file's; width, shade (0 black, 1 its colour's place) and opacity at points."""

    every: int = 1000
    cap: str = "round"
    base: Callable[[float], float] = float
    width: Of | None = None
    carried: float = 0.0  # how much of the polyline before goes into a width
    shade: Of | None = None
    opacity: Of | None = None
    faint: float = 1.0


#: How each pen draws.
STYLES = {
    "pen": Pen(),
    "fineliner": Pen(base=lambda w: 1.3 * w**2.1),
    "ballpoint": Pen(5, width=lambda p, b: 0.5 + p.pressure + p.width - p.speed / 100, shade=lambda p, b: 0.5 + 1.2 * p.pressure - p.speed / 350),
    "marker": Pen(3, width=lambda p, b: 0.9 * p.width - 0.36 * p.tilt, carried=0.1),
    "pencil": Pen(2, width=lambda p, b: np.minimum(10 * b, 0.7 * ((0.8 * b + 0.5 * p.pressure) * p.width - 0.25 * p.tilt**1.8 - 0.012 * p.speed)), opacity=lambda p, b: np.clip(p.pressure - p.speed / 350, 0, 1) - 0.1),
    "mechanical_pencil": Pen(base=lambda w: w**2, faint=0.7),
    "brush": Pen(2, width=lambda p, b: 0.7 * ((1 + 1.4 * p.pressure) * p.width - 0.5 * p.tilt - 0.01 * p.speed), shade=lambda p, b: 1.5 * (p.pressure**1.5 - 0.004 * p.speed)),
    "highlighter": Pen(cap="square", base=lambda w: 15.0, faint=0.3),
    "eraser": Pen(cap="square", base=lambda w: 2 * w),
    "erase_area": Pen(cap="square", faint=0.0),
    "calligraphy": Pen(2, width=lambda p, b: 0.9 * ((1 + p.pressure) * p.width - 0.3 * p.tilt), carried=0.1),
}


#: A stroke: its pen, colour, width and points (rows of x, y, speed, tilt, width, pressure).
Stroke = tuple[str, int, float, np.ndarray]


def drawn(strokes: list[Stroke]) -> list[list[tuple[str, float, float, int, int]]]:
    """Colour, width, opacity and points (from, to) of each polyline of each stroke; those of one pen are computed at once."""
    out: list[list[tuple[str, float, float, int, int]]] = [[] for _ in strokes]
    by_pen: dict[str, list[int]] = {}
    for i, (pen, *_, values) in enumerate(strokes):
        if len(values):
            by_pen.setdefault(pen, []).append(i)
    for pen, own in by_pen.items():
        style, sizes = STYLES[pen], np.array([len(strokes[i][3]) for i in own])
        counts = -(-sizes // style.every)
        of = np.repeat(np.arange(len(own)), counts)
        starts = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * style.every
        at = Points(*np.concatenate([strokes[i][3][:: style.every] for i in own]).T)
        base = np.array([style.base(strokes[i][2]) for i in own])[of]
        widths = (base if style.width is None else np.asarray(style.width(at, base), float)).tolist()
        for k in range(1, len(widths) if style.carried else 0):
            if starts[k]:
                widths[k] += style.carried * widths[k - 1]
        opacity = np.full(len(of), style.faint) if style.opacity is None else style.opacity(at, base)
        rgb = np.array([COLOURS.get(strokes[i][1], (0, 0, 0)) for i in own])[of]
        if style.shade is not None:
            full = 255 - rgb if pen == "brush" else np.full(3, 255)
            rgb = ((1 - np.clip(style.shade(at, base), 0, 1))[:, None] * full).astype(int)
        ends = np.minimum(starts + style.every, sizes[of])
        for i, c, w, o, a, z in zip(of.tolist(), rgb.tolist(), widths, opacity.tolist(), starts.tolist(), ends.tolist(), strict=True):
            out[own[i]].append((f"rgb({c[0]},{c[1]},{c[2]})", w, o, max(0, a - 1), z))
    return out


def polylines(pen: str, colour: int, width: float, points: Points, scale: tuple[float, float] = (1.0, 1.0)) -> list[tuple[str, float, float, np.ndarray]]:
    """Colour, width, opacity and points (rows of x, y) of each polyline; each starts where the one before ends."""
    values = np.stack([points.x, points.y, points.speed, points.tilt, points.width, points.pressure], 1)
    (lines,) = drawn([(pen, colour, width, values)])
    return [(c, w, o, values[a:z, :2] * scale) for c, w, o, a, z in lines]


def strokes_of(content: bytes) -> list[Stroke]:
    """The strokes of a page; nothing of a page that is cut short or of another version."""
    which = version(content or b"")
    if which not in (3, 5):
        return []
    head, at, out = struct.Struct("<IIIffI" if which == 5 else "<IIIfI"), HEADER, []
    try:
        (layers,) = struct.unpack_from("<I", content, at)
        at += 4
        for _ in range(layers):
            (count,) = struct.unpack_from("<I", content, at)
            at += 4
            for _ in range(count):
                pen, colour, _, width, *_, n = head.unpack_from(content, at)
                at += head.size
                values = np.frombuffer(content, "<f4", 6 * n, at).reshape(n, 6).astype(float)
                at += 24 * n
                out.append((PENS.get(pen, "pen"), colour, width, values))
    except (struct.error, ValueError):
        return []
    return out


def svgs(contents: Iterable[bytes | None], width: float = WIDTH, height: float = HEIGHT) -> list[str]:
    """The pages, scaled so that the strokes keep the proportions of the device's page."""
    ratio = (height / width) / (HEIGHT / WIDTH)
    scale = (max(ratio, 1) * width / WIDTH, max(1 / ratio, 1) * height / HEIGHT)
    pages = [strokes_of(x or b"") for x in contents]
    found, out = iter(drawn([s for page in pages for s in page])), []
    for page in pages:
        lines = [f'<svg xmlns="http://www.w3.org/2000/svg" height="{height}" width="{width}">']
        for pen, _, _, values in page:
            cap, places = STYLES[pen].cap, [f"{x:.3f},{y:.3f}" for x, y in (values[:, :2] * scale).tolist()]
            for shade, w, o, a, z in next(found):
                lines.append(f'<polyline style="fill:none;stroke:{shade};stroke-width:{w:.3f};opacity:{o:.3g}" stroke-linecap="{cap}" points="{" ".join(places[a:z])}"/>')
        out.append("\n".join([*lines, "</svg>"]))
    return out


def svg(content: bytes | None, width: float = WIDTH, height: float = HEIGHT) -> str:
    return svgs([content], width, height)[0]


def with_svg(files: DataFrame, width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """path and svg of page files (path, content)."""

    def run(batches):
        for b in batches:
            sizes = np.cumsum([len(x or b"") for x in b["content"]]) // BYTES  # of a batch of large pages, some at once
            for _, own in b.groupby(sizes):
                yield pd.DataFrame({"path": own["path"], "svg": svgs((bytes(x or b"") for x in own["content"]), width, height)})

    return files.select("path", "content").mapInPandas(run, "path string, svg string")
