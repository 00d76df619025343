"""Ingestion: routing of files, parsing in Arrow batches, validation, quarantine and schema inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of each route. A format belongs to one route.
ROUTES: dict[str, list[str]] = {
    "text": ["txt", "md", "json", "jsonl", "yaml", "yml"],
    "presentation": ["pptx"],
    "word": ["docx", "doc"],
    "document": ["pdf", "png", "jpg", "jpeg", "gif", "webp", "tif", "tiff"],
    "spreadsheet_service": ["xlsx", "xls"],
}


def route_table(routes: dict[str, list[str]] = ROUTES) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, formats in routes.items():
        for f in formats:
            if f in out:
                raise ValueError(f"format {f!r} is registered for {out[f]!r} and {name!r}")
            out[f] = name
    return out


def route(fmt: Column, routes: dict[str, list[str]] = ROUTES) -> Column:
    """The one route of a format, 'unsupported' if there is none."""
    known = F.create_map(*[F.lit(x) for kv in route_table(routes).items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(fmt)), F.lit("unsupported"))


def split_spreadsheets(files: DataFrame, fmt: str) -> tuple[DataFrame, DataFrame]:
    """Files for the document pipeline and for the spreadsheet service."""
    sheet = F.coalesce(F.lower(F.col(fmt)).isin(ROUTES["spreadsheet_service"]), F.lit(False))
    return files.filter(~sheet), files.filter(sheet)
