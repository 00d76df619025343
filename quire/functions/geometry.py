"""Boxes: [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(c: Column) -> Column:
    """The box if it has four numbers and a positive area, else null."""
    ok = (F.size(c) == 4) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & (c[2] > c[0]) & (c[3] > c[1])
    return F.when(ok, c)


def box_of_text(c: Column) -> Column:
    """A box written as four numbers in a text."""
    return box(F.transform(F.regexp_extract_all(c, F.lit(r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"), F.lit(0)), lambda x: x.cast("double")))


def area(c: Column) -> Column:
    b = box(c)
    return (b[2] - b[0]) * (b[3] - b[1])


def union_agg(c: Column) -> Column:
    """Aggregate: the smallest box around all boxes."""
    b = box(c)
    return F.when(F.count(b) > 0, F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])))


def polygon(c: Column) -> Column:
    return F.array(F.array(c[0], c[1]), F.array(c[2], c[1]), F.array(c[2], c[3]), F.array(c[0], c[3]))


def box_of_polygon(c: Column) -> Column:
    """Bounds of a polygon of at least three points."""
    xs, ys = F.transform(c, lambda p: p[0]), F.transform(c, lambda p: p[1])
    return F.when(F.size(c) >= 3, box(F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))))


def crop(c: Column, width: Column, height: Column, margin: float) -> Column:
    """The box with a margin (a share of its sides), in whole pixels, clamped to the image."""
    dx, dy = (c[2] - c[0]) * margin, (c[3] - c[1]) * margin
    return F.array(F.greatest(F.lit(0), F.floor(c[0] - dx)), F.greatest(F.lit(0), F.floor(c[1] - dy)), F.least(width, F.ceil(c[2] + dx)), F.least(height, F.ceil(c[3] + dy)))


def crop_scale(width: Column, height: Column, max_edge: float, max_pixels: float, target_edge: float) -> Column:
    """Least of the three ratios; 1 if it would change the size by less than a hundredth."""
    edge = F.greatest(width, height)
    s = F.least(F.lit(max_edge) / edge, F.sqrt(F.lit(max_pixels) / (width * height)), F.lit(target_edge) / edge)
    return F.when(F.abs(s - 1) < 0.01, F.lit(1.0)).otherwise(s)


def clamp(c: Column, width: Column, height: Column) -> Column:
    """The box within the canvas, null if nothing is left."""
    return box(F.array(F.greatest(F.lit(0.0), c[0]), F.greatest(F.lit(0.0), c[1]), F.least(width.cast("double"), c[2]), F.least(height.cast("double"), c[3])))


def canvas_edge(c: Column) -> Column:
    """A canvas edge for the greatest coordinate seen: rounded up to 128, at least 1536."""
    return F.greatest(F.lit(1536), (F.ceil(c / 128) * 128).cast("int"))


def percent(c: Column, width: Column, height: Column) -> Column:
    """left, top, width, height in percent of the canvas, five decimals."""
    return F.struct(*[F.format_string("%.5f", (v * 100.0)).alias(n) for n, v in (("left", c[0] / width), ("top", c[1] / height), ("width", (c[2] - c[0]) / width), ("height", (c[3] - c[1]) / height))])


def page_number(page: Column, component: Column) -> Column:
    """The page given, else the one in the component path."""
    return F.coalesce(page, F.regexp_extract(component, r"^/page/(\d+)/", 1).try_cast("int"))
