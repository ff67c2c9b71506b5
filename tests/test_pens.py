"""Polylines by expressions against those that the SVG of pages is made of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import pens
from quillspark.sources import drawing

KEYS = ("x", "y", "speed", "tilt", "width", "pressure")


def test_every_pen(spark):
    rng, rows = np.random.default_rng(5), []
    for pen in drawing.STYLES:
        for n in (1, 2, 3, 7, 61):
            points = [dict(zip(KEYS, (float(v) for v in (rng.random() * 1000, rng.random() * 1000, rng.random() * 50, rng.random() * 2, 1 + rng.random() * 20, rng.random())), strict=True)) for _ in range(n)]
            rows.append((len(rows), pen, n % 4, 2.0, points))
    rows += [(900, "pen", 0, 2.0, []), (901, "pen", 0, 2.0, None)]
    strokes = spark.createDataFrame(rows, "id int, pen string, colour int, width double, points array<struct<x double, y double, speed double, tilt double, width double, pressure double>>")
    colours = F.create_map(*[x for k, v in drawing.COLOURS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = pens.polylines(strokes).withColumn("rgb", pens.rgb(F.col("pen"), F.col("shade"), colours[F.col("colour")]))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r["at"]): r for r in found.collect()}
    for i, pen, colour, width, points in rows[:-2]:
        own = drawing.Points(*[np.array([p[k] for p in points]) for k in KEYS])
        want = drawing.polylines(pen, colour, width, own)
        assert len(want) == sum(1 for k in got if k[0] == i)
        for at, (shade, w, o, xy) in enumerate(want):
            r = got[i, at]
            assert (r.line_width, r.opacity) == pytest.approx((w, o), rel=1e-12) and r.rgb == shade
            assert [(p.x, p.y) for p in r.line] == [tuple(x) for x in xy]
    assert not [k for k in got if k[0] >= 900]
