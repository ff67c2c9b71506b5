"""Polylines of strokes as expressions: their width, shade and opacity by pen, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each pen draws. p is the point that a polyline starts at, base the stroke's width by pen; a pen that isn't named draws as "".
BASE = {"fineliner": "1.3 * power(width, 2.1)", "mechanical_pencil": "width * width", "highlighter": "15.0", "eraser": "2 * width", "": "width"}
EVERY = {"ballpoint": "5", "marker": "3", "pencil": "2", "brush": "2", "calligraphy": "2", "": "1000"}
WIDTH = {
    "ballpoint": "0.5 + p.pressure + p.width - p.speed / 100",
    "marker": "0.9 * p.width - 0.36 * p.tilt",
    "pencil": "least(10 * base, 0.7 * ((0.8 * base + 0.5 * p.pressure) * p.width - 0.25 * power(p.tilt, 1.8) - 0.012 * p.speed))",
    "brush": "0.7 * ((1 + 1.4 * p.pressure) * p.width - 0.5 * p.tilt - 0.01 * p.speed)",
    "calligraphy": "0.9 * ((1 + p.pressure) * p.width - 0.3 * p.tilt)",
    "": "base",
}
CARRIED = {"marker": "0.1", "calligraphy": "0.1", "": "0.0"}
SHADE = {"ballpoint": "0.5 + 1.2 * p.pressure - p.speed / 350", "brush": "1.5 * (power(p.pressure, 1.5) - 0.004 * p.speed)", "": "NULL"}
OPACITY = {"pencil": "least(greatest(p.pressure - p.speed / 350, 0), 1) - 0.1", "mechanical_pencil": "0.7", "highlighter": "0.3", "erase_area": "0.0", "": "1.0"}
#: Points whose widths go into one: a tenth of the one before each time, so those farther back are below a double's last bit.
REACH = 20


def by_pen(values: dict[str, str], kind: str = "DOUBLE") -> str:
    """SQL for both engines of the tests."""
    cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS {kind})" for k, v in values.items() if k)
    return f"CASE pen {cases} ELSE CAST({values['']} AS {kind}) END"


def polylines(strokes: DataFrame) -> DataFrame:
    """A row for each polyline of each stroke: the other columns, at (from 0), line_width, shade (0 to 1; null: the colour's own), opacity and line (points).

    strokes: pen, width and points (array of x, y, speed, tilt, width, pressure; doubles). A polyline begins at the last point of the one before.
    Strokes without points (null or empty) have no row.
    """
    others = [c for c in strokes.columns if c not in ("points", "width")]
    own = strokes.filter(F.size("points") > 0).withColumn("base", F.expr(by_pen(BASE))).withColumn("every", F.expr(by_pen(EVERY, "INT"))).withColumn("starts", F.expr("sequence(1, size(points), every)"))
    own = own.withColumn("raw", F.expr(f"transform(transform(starts, s -> element_at(points, s)), p -> {by_pen(WIDTH)})")).withColumn("carried", F.expr(by_pen(CARRIED)))
    each = own.select(*others, "points", "raw", "carried", "every", F.posexplode("starts").alias("at", "s")).withColumn("p", F.expr("element_at(points, s)"))
    width = F.expr(f"aggregate(slice(raw, greatest(1, at + 1 - {REACH}), least(at + 1, {REACH + 1})), 0D, (a, w) -> a * carried + w)")
    shade = F.expr(f"least(greatest({by_pen(SHADE)}, 0D), 1D)")
    line = F.expr("slice(points, greatest(1, s - 1), s + every - greatest(1, s - 1))")
    shade = F.when(F.col("pen").isin([k for k in SHADE if k]), shade)
    return each.select(*others, "at", width.alias("line_width"), shade.alias("shade"), F.expr(by_pen(OPACITY)).alias("opacity"), line.alias("line"))


def rgb(pen: Column, shade: Column, colour: Column) -> Column:
    """What SVG calls a shade; colour: an array of three numbers."""
    full = F.transform(colour, lambda c: F.when(pen == "brush", 255 - c).otherwise(255))
    shaded = F.transform(full, lambda c: ((1 - shade) * c).cast("int"))
    return F.concat(F.lit("rgb("), F.array_join(F.when(shade.isNull(), colour).otherwise(shaded), ","), F.lit(")"))
