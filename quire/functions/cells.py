"""Cells, headers and rows of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import strip
from quire.functions.vectors import let


def cell(c: Column, kind: T.DataType) -> Column:
    """A cell as text: '' for null, true/false, ISO times, dates without midnight, whole floats without a point, plain decimals."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "true").otherwise("false")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
        day, time, part = F.date_format(c, "yyyy-MM-dd"), F.date_format(c, "'T'HH:mm:ss"), F.date_format(c, "SSSSSS")
        text = F.when(whole, day).otherwise(F.concat(day, time, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise("")))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(c == F.floor(c), F.format_string("%.0f", c.cast("double"))).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "").otherwise(text)


def cells(df: DataFrame, columns: list[str]) -> Column:
    """A row of cells."""
    return F.array(*[cell(F.col(c), df.schema[c].dataType) for c in columns])


def unique_headers(values: Column, reserved: list[str] | None = None) -> Column:
    """Trimmed headers; a blank one is column_i, a name in use gets _2, _3, .. until it is free."""
    names = F.transform(values, lambda v, i: F.coalesce(F.nullif(strip(F.coalesce(v, F.lit(""))), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array(*[F.lit(r) for r in reserved or []]).cast("array<string>").alias("used"))

    def add(a: Column, base: Column) -> Column:
        tries = F.concat(F.array(base), F.transform(F.sequence(F.lit(2), F.size(a["used"]) + 2), lambda k: F.concat(base, F.lit("_"), k.cast("string"))))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(a["used"], t)), 1)
        return F.struct(F.concat(a["out"], F.array(free)).alias("out"), F.concat(a["used"], F.array(free)).alias("used"))

    return F.aggregate(names, start, add, lambda a: a["out"])


def trim_outer_rows(rows: Column) -> Column:
    """Structs row (number from 1) and cells, without empty rows at both ends; inner gaps stay."""
    filled = F.transform(rows, lambda r, i: F.struct((i + 1).alias("row"), r.alias("cells"), F.exists(r, lambda c: F.length(strip(F.coalesce(c, F.lit("")))) > 0).alias("full")))

    def inner(rs: Column) -> Column:
        at = F.transform(F.filter(rs, lambda r: r["full"]), lambda r: r["row"])
        return let(F.struct(F.array_min(at).alias("lo"), F.array_max(at).alias("hi")), lambda e: F.transform(F.filter(rs, lambda r: r["row"].between(e["lo"], e["hi"])), lambda r: F.struct(r["row"].alias("row"), r["cells"].alias("cells"))))

    return let(filled, inner)


SEPARATOR = r"^\s*\|?[\s:|-]+\|?\s*$"


def markdown_lines(content: Column) -> Column:
    """Lines that are not blank, as structs start, end (characters from 0) and line."""
    raw = F.split(content, "\n")
    ends = F.aggregate(
        raw, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,line:string>>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("line")))).alias("out")),
        lambda a: a["out"],
    )
    return F.filter(ends, lambda x: F.length(strip(x["line"])) > 0)


def header_lines(lines: Column) -> Column:
    """1, or 2 with a separator line; 0 for no lines."""
    return F.when(F.size(lines) == 0, 0).when(F.try_element_at(lines, F.lit(2))["line"].rlike(SEPARATOR), 2).otherwise(1)
