"""Parsers of text and office files, from bytes, with nothing but the standard library.

A parser gives title, main text, tables (caption, headers, rows) and layout blocks. parse_files() runs them in Arrow batches; an
exception becomes a failed outcome of its file, never of the job. Formats that need a service or program are deferred.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

SCHEMA = "object_id string, source_uri string, status string, error_type string, error_message string, title string, text string, tables array<struct<name:string,headers:array<string>,rows:array<array<string>>>>, blocks array<struct<component_id:string,page:int,block_index:int,type:string,text:string>>, unsupported map<string,int>, pictures array<struct<name:string,alt:string,page:int,content:binary>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M)


class Parsed:
    """What a parser finds: title, texts in order, tables, layout blocks, pictures (name, alt, page, content), and how often content of
    each kind was met that it does not read."""

    def __init__(self, title: str | None = None) -> None:
        self.title, self.lines, self.tables, self.blocks, self.pictures = title, [], [], [], []
        self.unsupported: Counter = Counter()
        self._on_page: Counter = Counter()

    def add(self, kind: str, text: str, page: int = 0) -> None:
        index = self._on_page[page]
        self._on_page[page] += 1
        self.blocks.append({"component_id": f"/page/{page}/{kind}/{index}", "page": page, "block_index": index, "type": kind, "text": text})
        self.lines.append(text)

    def picture(self, about: ET.Element | None, part: str | None, z: zipfile.ZipFile, page: int = 0) -> None:
        """A picture of the file: its bytes, and its description as a block, unless that is only a made-up name."""
        said = next((x for x in ((about.get(k) or "").strip() for k in ("descr", "title", "name")) if x and not _MADE_UP.fullmatch(x)), "") if about is not None else ""
        if said:
            self.add("Picture", clean(said), page)
        if part and part in z.namelist():
            self.pictures.append({"name": part.rpartition("/")[2], "alt": said or None, "page": page, "content": z.read(part)})

    @property
    def text(self) -> str:
        return "\n\n".join(x for x in self.lines if x.strip())


_MADE_UP = re.compile(r"(?:picture|image|graphic)\s+\d+", re.I)  # fixed value: names that say nothing


def _parts(z: zipfile.ZipFile, of: str) -> dict[str, str]:
    """Relation ids of a part to the parts they name."""
    folder, _, file = of.rpartition("/")
    rels = f"{folder}/_rels/{file}.rels"
    if rels not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(r.get("Target").lstrip("/") if (r.get("Target") or "").startswith("/") else f"{folder}/{r.get('Target')}") for r in ET.fromstring(z.read(rels)) if r.get("TargetMode") != "External"}


def clean(text: str) -> str:
    return "\n".join(x.rstrip() for x in text.replace("\r", "").split("\n")).strip()


def plain_text(data: bytes, name: str) -> Parsed:
    """UTF-8 without its mark, bad bytes replaced; JSON must parse; the first heading is the title of Markdown."""
    text = data.decode("utf-8-sig", errors="replace")
    if name.lower().endswith(".json"):
        json.loads(text)
    m = _HEADING.search(text) if name.lower().endswith(".md") else None
    p = Parsed(m[1].strip() if m else name.rpartition("/")[2].rpartition(".")[0])
    if text:
        p.add("Text", text)
        p.lines = [text]
    return p


def _table(p: Parsed, name: str, rows: list[list[str]], page: int = 0) -> None:
    if rows:
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        p.tables.append({"name": name, "headers": rows[0], "rows": rows[1:]})
        cell = lambda c: c.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
        line = lambda r: "| " + " | ".join(map(cell, r)) + " |"
        p.add("Table", "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])]), page)


def docx(data: bytes, name: str) -> Parsed:
    """Paragraphs (headings, list items with their level), tables and pictures of a word-processor file, in order."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body, parts = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body"), _parts(z, "word/document.xml")
    p = Parsed()

    def words(e: ET.Element) -> str:
        out = []
        for x in e.iter():
            if x.tag == f"{_W}t":
                out.append(x.text or "")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
            elif x.tag == f"{_W}tab":
                out.append("\t")
        return clean("".join(out))

    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            text = words(e)
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = e.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
            kind = (style.get(f"{_W}val") or "") if style is not None else ""
            for drawing in e.iter(f"{_W}drawing"):
                blip = drawing.find(f".//{_A}blip")
                if blip is None:
                    p.unsupported["drawing"] += 1
                else:
                    p.picture(next((x for x in drawing.iter() if x.tag.endswith("}docPr")), None), parts.get(blip.get(f"{_R}embed")), z)
            p.unsupported.update({k: n for k in ("object", "pict") if (n := sum(1 for _ in e.iter(f"{_W}{k}")))})
            if not text:
                continue
            if kind.lower() == "title" or kind.lower().startswith("heading"):
                p.title = p.title or text
                p.add("SectionHeader", text)
            elif e.find(f"{_W}pPr/{_W}numPr") is not None:
                p.add("ListItem", "  " * int(level.get(f"{_W}val") or 0 if level is not None else 0) + "- " + text)
            else:
                p.add("Text", text)
        elif e.tag == f"{_W}tbl":
            _table(p, f"Table {len(p.tables) + 1}", [[words(c) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")])
        elif e.tag != f"{_W}sectPr":
            p.unsupported[e.tag.rpartition("}")[2]] += 1
    p.title = p.title or name.rpartition("/")[2].rpartition(".")[0]
    return p


def pptx(data: bytes, name: str) -> Parsed:
    """Slides in the order of the presentation (without its list, of their numbers); on each the title first, then placeholders, then
    other shapes from top left; groups are entered."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if "ppt/presentation.xml" in z.namelist():
        named = _parts(z, "ppt/presentation.xml")
        listed = [named.get(x.get(f"{_R}id")) for x in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
        slides = [n for n in listed if n in set(slides)] or slides
    p = Parsed()
    for page, (slide, root) in enumerate((n, ET.fromstring(z.read(n))) for n in slides):
        parts = _parts(z, slide)
        shapes = []
        for k, s in enumerate(x for x in root.iter() if x.tag in (f"{_P}sp", f"{_P}graphicFrame", f"{_P}pic")):
            ph = s.find(f".//{_P}nvPr/{_P}ph")
            off = s.find(f".//{_A}off")
            if off is None:
                off = s.find(f".//{_P}xfrm/{_A}off")
            rank = 2 if ph is None else 0 if (ph.get("type") or "") in ("title", "ctrTitle") else 1
            shapes.append((rank, int(off.get("y", 0)) if off is not None else 0, int(off.get("x", 0)) if off is not None else 0, k, s))
        for rank, *_, s in sorted(shapes, key=lambda x: x[:4]):
            lines = lambda e: clean("\n".join("".join(t.text or "" for t in par.iter(f"{_A}t")) for par in e.iter(f"{_A}p")))
            if s.tag == f"{_P}graphicFrame" and s.find(f".//{_A}tbl") is None:
                p.unsupported["graphicFrame"] += 1
            elif s.tag == f"{_P}graphicFrame":
                _table(p, f"Table {len(p.tables) + 1}", [[lines(c) for c in r.findall(f"{_A}tc")] for r in s.iter(f"{_A}tr")], page)
            elif s.tag == f"{_P}pic":
                blip = s.find(f".//{_A}blip")
                p.picture(s.find(f".//{_P}cNvPr"), parts.get(blip.get(f"{_R}embed")) if blip is not None else None, z, page)
            elif text := lines(s):
                p.title = p.title or (text if rank == 0 else None)
                p.add("Title" if rank == 0 else "Text", text, page)
    p.title = p.title or name.rpartition("/")[2].rpartition(".")[0]
    return p


def _serial(value: float) -> str:
    """A date or time of day from a spreadsheet's day number."""
    if value < 1:
        return (datetime(1900, 1, 1) + timedelta(seconds=round(value * 86400))).time().isoformat()
    moment = datetime(1899, 12, 30) + timedelta(seconds=round(value * 86400))
    return date.isoformat(moment.date()) if moment.time() == datetime.min.time() else moment.isoformat()


def xlsx(data: bytes, name: str) -> Parsed:
    """Every sheet as a table, outer empty rows trimmed; formulas as text, dates in ISO form, whole numbers without a point."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(f"{_R}id")], s.get("state") or "visible") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{_S}numFmt")}
            for i, xf in enumerate(styles.find(f"{_S}cellXfs") if styles.find(f"{_S}cellXfs") is not None else ()):
                k = int(xf.get("numFmtId") or 0)
                if 14 <= k <= 22 or 45 <= k <= 47 or re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")), re.I):
                    dates.add(i)
        p = Parsed(name.rpartition("/")[2].rpartition(".")[0])
        for title, target, state in sheets:
            p.unsupported.update({f"{state}_sheet": 1} if state != "visible" else {})
            root = ET.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
            rows: dict[int, dict[int, str]] = {}
            for c in root.iter(f"{_S}c"):
                col, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                k = 0
                for ch in col:
                    k = k * 26 + ord(ch) - 64
                rows.setdefault(int(row), {})[k - 1] = _cell(c, shared, dates)
            filled = [r for r, cs in rows.items() if any(v.strip() for v in cs.values())]
            if filled:
                width = max(k for r in filled for k, v in rows[r].items() if v.strip()) + 1
                _table(p, title, [[rows.get(r, {}).get(k, "") for k in range(width)] for r in range(min(filled), max(filled) + 1)], len(p.tables))
    return p


def _cell(c: ET.Element, shared: list[str], dates: set[int]) -> str:
    f, v, kind = c.find(f"{_S}f"), c.find(f"{_S}v"), c.get("t")
    if f is not None and f.text:
        return "=" + f.text
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_S}t"))
    raw = (v.text or "") if v is not None else ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind in ("str", "e") or not raw:
        return raw
    x = float(raw)
    if int(c.get("s") or 0) in dates:
        return _serial(x)
    return str(int(x)) if x.is_integer() else raw


PARSERS = {**dict.fromkeys(["txt", "md", "json", "jsonl", "yaml", "yml"], plain_text), "docx": docx, "pptx": pptx, "xlsx": xlsx}
DEFERRED = {"pdf", "png", "jpg", "jpeg", "gif", "webp", "tif", "tiff", "doc", "xls"}


def unsupported_counts(outcomes: DataFrame) -> DataFrame:
    """Content that the parsers met and did not read, by kind, over all files."""
    return outcomes.select(F.explode("unsupported").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


def parse_files(objects: DataFrame, providers: dict | None = None, pictures: bool = False) -> DataFrame:
    """Outcome of every file (object_id, uri, content): success, deferred, unsupported or failed with its error.

    providers: format -> f(bytes, name) -> Parsed, for formats that need a service; without one they are deferred. pictures: whether the
    bytes of pictures are wanted.
    """
    parsers = {**PARSERS, **(providers or {})}
    schema = pa.schema([("object_id", pa.string()), ("source_uri", pa.string()), ("status", pa.string()), ("error_type", pa.string()), ("error_message", pa.string()), ("title", pa.string()), ("text", pa.string()), ("tables", pa.list_(pa.struct([("name", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))), ("blocks", pa.list_(pa.struct([("component_id", pa.string()), ("page", pa.int32()), ("block_index", pa.int32()), ("type", pa.string()), ("text", pa.string())]))), ("unsupported", pa.map_(pa.string(), pa.int32())), ("pictures", pa.list_(pa.struct([("name", pa.string()), ("alt", pa.string()), ("page", pa.int32()), ("content", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, uri, fmt, data in zip(*(c.to_pylist() for c in b.columns)):
                row = {"object_id": i, "source_uri": uri, "status": "success", "error_type": None, "error_message": None, "title": None, "text": None, "tables": [], "blocks": [], "unsupported": [], "pictures": []}
                if fmt not in parsers:
                    row["status"] = "deferred" if fmt in DEFERRED else "unsupported"
                else:
                    try:
                        p = parsers[fmt](data or b"", uri)
                        row |= {"title": p.title, "text": p.text, "tables": p.tables, "blocks": p.blocks, "unsupported": sorted(p.unsupported.items()), "pictures": p.pictures if pictures else []}
                    except Exception as e:  # noqa: BLE001 (one bad file must not end the job)
                        row |= {"status": "failed", "error_type": type(e).__name__, "error_message": str(e)}
                out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return objects.select("object_id", F.col("uri").alias("source_uri"), X.file_format(F.col("uri")).alias("fmt"), "content").mapInArrow(run, SCHEMA)


def replayed(results: dict[str, dict]):
    """A provider that gives recorded results by file name: title, text, tables, blocks. For tests and offline runs."""

    def parse(_: bytes, name: str) -> Parsed:
        r = results[name.rpartition("/")[2]]
        p = Parsed(r.get("title"))
        p.lines, p.tables, p.blocks = [r.get("text") or ""], r.get("tables") or [], r.get("blocks") or []
        return p

    return parse


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """Pages of recognised documents (object_id, page, text, tokens, error) to one row a document once all its pages are there."""
    return pages.groupBy("object_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n\n").alias("text"), F.count("*").alias("page_count"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.count_if(F.col("error").isNotNull()).alias("failed_pages"))
