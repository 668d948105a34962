"""Word files to ordered blocks."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Elements whose text is deleted or is no text, and what others stand for.
SILENT = {SPACE + t for t in ("del", "delText", "instrText", "fldChar", "proofErr")}
STANDS_FOR = {SPACE + "tab": "\t", SPACE + "br": "\n", SPACE + "cr": "\n", SPACE + "noBreakHyphen": "-"}
SCHEMA = "spec_id string, source string, pos long, kind string, style string, text string, rows array<array<string>>"


def text_of(node) -> str:
    """All text below ``node`` in order."""
    out, stack = [], list(reversed(node))
    while stack:
        x = stack.pop()
        if x.tag in SILENT:
            continue
        if x.tag == SPACE + "t":
            out.append(x.text or "")
        elif x.tag in STANDS_FOR:
            out.append(STANDS_FOR[x.tag])
        else:
            stack.extend(reversed(x))
    return "".join(out).replace("\xa0", " ")


def row_cells(row) -> list[str]:
    """A table row's cells; a cell that spans several columns is followed by empty ones."""
    cells = []
    for cell in row.iterfind(SPACE + "tc"):
        lines = (text_of(p).strip() for p in cell.iterfind(SPACE + "p"))
        span = cell.find(f"{SPACE}tcPr/{SPACE}gridSpan")
        width = 1 if span is None else int(span.get(SPACE + "val") or 1)
        cells += ["\n".join(filter(None, lines))] + [""] * (width - 1)
    return cells


def blocks_of(content: bytes) -> list[dict]:
    """Paragraphs (kind p) and tables (kind t) of a file's body in reading order; none if it has no body."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            return []
        body = ElementTree.fromstring(z.read("word/document.xml")).find(SPACE + "body")
    out: list[dict] = []
    for x in body if body is not None else ():
        if x.tag == SPACE + "p" and (text := text_of(x).strip()):
            style = x.find(f"{SPACE}pPr/{SPACE}pStyle")
            out.append({"kind": "p", "style": "" if style is None else style.get(SPACE + "val") or "", "text": text, "rows": None})
        elif x.tag == SPACE + "tbl" and (rows := [r for r in map(row_cells, x.iterfind(SPACE + "tr")) if r]):
            out.append({"kind": "t", "style": "", "text": "", "rows": rows})
    return out


def read_blocks(parts: DataFrame) -> DataFrame:
    """Blocks of Word files (spec_id, part, name, content); ``pos`` orders them within a specification."""

    def run(batches):
        for batch in batches:
            rows = []
            for spec, part, name, data in zip(*(c.to_pylist() for c in batch.columns)):
                if name.lower().endswith(".docx"):
                    rows += [{"spec_id": spec, "source": name, "pos": (part << 32) + i} | b for i, b in enumerate(blocks_of(data))]
            kinds = pa.schema([("spec_id", pa.string()), ("source", pa.string()), ("pos", pa.int64()), ("kind", pa.string()), ("style", pa.string()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return parts.selectExpr("spec_id", "cast(part as long) part", "name", "content").mapInArrow(run, SCHEMA)
