"""Documents to text with locations: CSV, text and Markdown, DOCX and XLSX."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, MOST_ROWS, MOST_COLUMNS, CELL_CHARS = 25, 1000, 50, 1000
EXPANDED, RATIO, ENTRIES, MOST_PARAGRAPHS = 20_000_000, 100, 500, 100
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class Refused(ValueError):
    """Why a document can't be imported."""


def row_blocks(rows: DataFrame, order: list[str], columns: list[str], keys: list[str] = (), size: int = BLOCK_ROWS) -> DataFrame:
    """(keys, block, label, content): rows in order, cells joined by ` | `, in blocks of `size` with a label `Rows a-b`.

    Rows are numbered within a key, so keys are numbered side by side.
    """
    line = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = rows.select(*keys, line.alias("line"), n.alias("n")).withColumn("block", F.floor((F.col("n") - 1) / size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    blocks = numbered.groupBy(*keys, "block").agg(F.min("n").alias("a"), F.max("n").alias("b"), joined.alias("content"))
    label = F.concat(F.lit("Rows "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"))
    return blocks.select(*keys, "block", label.alias("label"), "content")


def formula(cell: Column) -> Column:
    """Whether a cell would be run as a formula."""
    return cell.rlike(r"^\s*[=+\-@]")


def table_text(body: bytes) -> list[tuple[str, str]]:
    """(label, text) blocks of a CSV file: `,` `;` or tab, rows of one width, no formulas."""
    try:
        text = body.decode("utf-8-sig")
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t")
        rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r)]
    except (UnicodeError, csv.Error) as e:
        raise Refused("invalid_csv") from e
    if not 1 <= len(rows) <= MOST_ROWS or not 1 <= len(rows[0]) <= MOST_COLUMNS or len({len(r) for r in rows}) > 1:
        raise Refused("csv_shape")
    if any(len(c) > CELL_CHARS or re.match(r"[=+\-@]", c) for r in rows for c in r):
        raise Refused("csv_cell")
    return [(f"Rows {k + 1}-{min(k + BLOCK_ROWS, len(rows))}", "\n".join(" | ".join(r) for r in rows[k : k + BLOCK_ROWS])) for k in range(0, len(rows), BLOCK_ROWS)]


def plain_text(body: bytes) -> list[tuple[str, str]]:
    """(label, text): one part for each Markdown heading, or one for all."""
    try:
        text = body.decode("utf-8-sig")
    except UnicodeError as e:
        raise Refused("invalid_character_encoding") from e
    heads = list(re.finditer(r"^#{1,6}\s+(.+)$", text, re.M))
    if not heads:
        return [("Document", text.strip())] if text.strip() else []
    ends = [h.start() for h in heads[1:]] + [len(text)]
    before = [("Document", text[: heads[0].start()].strip())] if text[: heads[0].start()].strip() else []
    return before + [(h[1].strip(), text[h.start() : e].strip()) for h, e in zip(heads, ends)]


def _archive(body: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(body))
    except zipfile.BadZipFile as e:
        raise Refused("invalid_archive") from e
    infos = z.infolist()
    size = sum(i.file_size for i in infos)
    if len(infos) > ENTRIES or size > EXPANDED or any(i.file_size > RATIO * max(1, i.compress_size) for i in infos) or any(i.flag_bits & 1 for i in infos):
        raise Refused("unsafe_archive")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        raw = z.read(name)
    except KeyError as e:
        raise Refused("missing_part") from e
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.I):
        raise Refused("unsafe_xml")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise Refused("invalid_xml") from e


def word_text(body: bytes) -> list[tuple[str, str]]:
    """(label, text) of a DOCX file: the paragraphs under each heading."""
    label, parts, n = "Document", [], 0
    for p in _xml(_archive(body), "word/document.xml").iter(f"{_WORD}p"):
        line = "".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip()
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        if not line:
            continue
        n += 1
        if n > MOST_PARAGRAPHS:
            raise Refused("too_many_paragraphs")
        if style is not None and re.match("heading|title", style.get(f"{_WORD}val", ""), re.I):
            label = line
            parts.append((label, [line]))
        elif parts and parts[-1][0] == label:
            parts[-1][1].append(line)
        else:
            parts.append((label, [line]))
    return [(k, "\n\n".join(v)) for k, v in parts]


def _targets(z: zipfile.ZipFile) -> dict[str, str]:
    """Which part of a workbook each relationship names; sheets are found by it, not by their place."""
    if "xl/_rels/workbook.xml.rels" not in z.namelist():
        return {}
    return {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}


def sheet_text(body: bytes, most_cells: int = 5000, most_sheets: int = 20) -> list[tuple[str, str]]:
    """(`Sheet!first:last`, lines `REF: value`) of an XLSX file; formulas are refused."""
    z = _archive(body)
    shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in _xml(z, "xl/sharedStrings.xml").iter(f"{_SHEET}si")]
    listed = list(_xml(z, "xl/workbook.xml").iter(f"{_SHEET}sheet"))
    names = [s.get("name") for s in listed]
    if len(names) > most_sheets:
        raise Refused("too_many_sheets")
    out, count = [], 0
    targets = _targets(z)
    for k, (name, sheet) in enumerate(zip(names, listed), 1):
        lines, refs = [], []
        part = targets.get(sheet.get(_RELATION, ""), f"worksheets/sheet{k}.xml")
        for c in _xml(z, part.lstrip("/") if part.startswith("/") else f"xl/{part}").iter(f"{_SHEET}c"):
            if c.find(f"{_SHEET}f") is not None:
                raise Refused("formula")
            v = c.find(f"{_SHEET}v")
            value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
            if value.strip():
                count += 1
                lines.append(f"{c.get('r')}: {value.strip()}")
                refs.append(c.get("r"))
        if count > most_cells:
            raise Refused("too_many_cells")
        if lines:
            out.append((f"{name}!{refs[0]}:{refs[-1]}", "\n".join(lines)))
    return out


READERS = {".csv": table_text, ".txt": plain_text, ".md": plain_text, ".docx": word_text, ".xlsx": sheet_text}


def documents(files: DataFrame) -> DataFrame:
    """(path, content, sections, reason) of files as spark.read.format("binaryFile") gives them (path, content).

    sections has a label and a span of the content for each part; reason says why a file has no content.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, body in zip(pdf["path"], pdf["content"]):
                reader = READERS.get("." + path.rpartition(".")[2].lower())
                try:
                    if reader is None:
                        raise Refused("unsupported_extension")
                    text, spans = "", []
                    for label, part in reader(bytes(body)):
                        start = len(text) + 2 * bool(text)
                        text += "\n\n" * bool(text) + part
                        spans.append({"kind": "section", "label": label, "start": start, "end": len(text)})
                    if not 20 <= len(text) <= 20_000:
                        raise Refused("text_size_limit")
                    out.append((path, text, spans, None))
                except Refused as e:
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "content", "sections", "reason"])

    return files.select("path", "content").mapInPandas(rows, "path string, content string, sections array<struct<kind:string,label:string,start:int,end:int>>, reason string")


#: Documents that a manifest may list, a fixed value.
MOST_DOCUMENTS = 200


def known_contents(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content (checksum) a manifest has already."""
    return files.join(manifest.select("checksum").distinct(), "checksum", "left_semi")


def approved_documents(manifest: DataFrame, files: DataFrame, most: int = MOST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(manifest with the files added, refused (path, reason)) of files (path, content binary, source_id).

    A file is refused whose content the manifest has already, or an earlier path of the same batch; if the manifest
    would list more than `most` documents none is added and all are refused, so the caller keeps what there was.
    """
    own = files.select("path", "source_id", F.octet_length("content").cast("long").alias("byte_size"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"))
    first = own.groupBy("checksum").agg(F.min("path").alias("__first"))
    own = own.join(first, "checksum").join(manifest.select("checksum", F.lit(True).alias("__known")).distinct(), "checksum", "left")
    own = own.withColumn("reason", F.when(F.col("__known") | (F.col("path") != F.col("__first")), "already_approved"))
    room = manifest.agg(F.count("*").alias("a")).crossJoin(own.where("reason IS NULL").agg(F.count("*").alias("b"))).select((F.col("a") + F.col("b") > most).alias("full"))  # one row
    own = own.crossJoin(F.broadcast(room)).withColumn("reason", F.coalesce("reason", F.when(F.col("full"), "too_many_documents")))
    added = own.where("reason IS NULL").select(F.left(F.substring_index("checksum", ":", -1), F.lit(32)).alias("document_id"), "path", "source_id", "byte_size", "checksum", F.lit("active").alias("status"))
    return manifest.unionByName(added.select(*manifest.columns)), own.where("reason IS NOT NULL").select("path", "reason")
