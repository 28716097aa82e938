"""Stand-ins for scanned files, derived from the given tables.

The same CASE expressions run in Spark and in the oracle SQL; they only make
input (names, headers, errors), never results.
"""

from __future__ import annotations

import io
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, count, islice
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.functions.match import checked
from glintscan.functions.paths import expected_mime
from glintscan.functions.unzip import PORTION
from glintscan.session import checkpointed, run_dir
from glintscan.sources.files import open_fs, read_binary
from glintscan.sources.rules import rules_from_dict
from glintscan.sources.tables import texts

# Rules that occur in the given tables (the shape of a shipped rule file).
RULES = rules_from_dict(
    {
        "threshold": 0.95,
        "security_marks": ["License", "Copyright"],
        "sensitive_patterns": {
            "credential": {"keywords": ["token"], "weight": 0.98},
            "language": {"keywords": ["the", "then", "and", "les", "der"], "weight": 0.9},
        },
        "structured_patterns": {
            'token = "[0-9a-f]{40}"': 0.95,
            "[A-Za-z0-9.]+@[a-z0-9.]+": 0.95,
        },
        "number_patterns": ["[0-9]{16}", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"],
        "regex_patterns": {
            "card": {"pattern": r"\b\d{16}\b", "weight": 0.95},
            "ssn": {"pattern": r"\b\d{3}-\d{2}-\d{4}\b", "weight": 0.95},
            "ip": {"pattern": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "weight": 0.9},
        },
    }
)

EXT_CASE = """CASE doc_id % 16
 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' WHEN 2 THEN '.json' WHEN 3 THEN '.xml'
 WHEN 4 THEN '.md' WHEN 5 THEN '.yml' WHEN 6 THEN '.html' WHEN 7 THEN '.doc'
 WHEN 8 THEN '.xls' WHEN 9 THEN '.PPT' WHEN 10 THEN '.jpg' WHEN 11 THEN '.mp3'
 WHEN 12 THEN '.zip' WHEN 13 THEN '' WHEN 14 THEN '.docx' ELSE '.bin' END"""
STEM_CASE = """CASE doc_id % 13
 WHEN 0 THEN '~$' WHEN 1 THEN '.' WHEN 2 THEN '[5]' WHEN 3 THEN '__substg1.0_' ELSE 'f' END"""
DIR_CASE = "CASE WHEN doc_id % 17 = 0 THEN '/.hid' ELSE '' END"
HEADER_CASE = """CASE doc_id % 20
 WHEN 1 THEN '25504446' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '89504E470D0A1A0A'
 WHEN 4 THEN '47494638' WHEN 5 THEN '424D' WHEN 6 THEN '494433'
 WHEN 7 THEN '524946460000000057415645' WHEN 8 THEN '00000020667479704D3441'
 WHEN 9 THEN 'D0CF11E0A1B11AE1' WHEN 10 THEN '526172211A0700' WHEN 11 THEN '1F8B08'
 WHEN 12 THEN '377ABCAF271C' WHEN 13 THEN '504B0304' WHEN 14 THEN '52494646000000005745425020'
 WHEN 15 THEN '8CBAD9FF0ADA' WHEN 16 THEN '7B2261223A' ELSE '' END"""
OLE_TAIL_CASE = """CASE doc_id % 8
 WHEN 0 THEN '57006F007200640044006F006300' WHEN 1 THEN '576F7264446F63756D656E74'
 WHEN 2 THEN '0908100000060500' WHEN 3 THEN '5368656574' WHEN 4 THEN '506F776572506F696E7420446F63756D656E74'
 WHEN 5 THEN '53746F72696573436F6D70416E79536C696465' WHEN 6 THEN '456E6372797074696F6E496E666F' ELSE '' END"""
PATH_SQL = f"'/data/' || source || {DIR_CASE} || '/' || {STEM_CASE} || doc_id || {EXT_CASE}"
NAME_SQL = f"{STEM_CASE} || doc_id || {EXT_CASE}"
ERROR_SQL = "CASE WHEN n_chars < 200 THEN 'text too short' END"
CONTENT_SQL = """CASE doc_id % 10 WHEN 0 THEN '提取失败' WHEN 1 THEN '提取失败: timeout'
 WHEN 2 THEN '' WHEN 3 THEN '不支持的文件类型' ELSE text END"""

# Oracle side: the derived files and results as CTEs.
FILES_CTE = f"""f AS (SELECT doc_id, text, lang, source, n_chars, {PATH_SQL} AS path,
  {NAME_SQL} AS name, lower({EXT_CASE}) AS ext,
  {HEADER_CASE} || hex(encode(text)) AS hx FROM documents)"""
OLE_CTE = f"""o AS (SELECT doc_id, lower({EXT_CASE}) AS ext, {PATH_SQL} AS path, n_chars,
  'D0CF11E0A1B11AE1' || {OLE_TAIL_CASE} || hex(encode(text)) AS hx FROM documents)"""


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", *columns)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, length, content`` with header bytes before the text."""
    docs = documents(spark, sf_dir, "text", "source", "n_chars", "lang")
    content = F.concat(F.unhex(F.expr(HEADER_CASE)), F.encode("text", "UTF-8"))
    return docs.select(
        "doc_id",
        "lang",
        "n_chars",
        F.expr(PATH_SQL).alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("bigint").alias("length"),
    )


def ole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the OLE header, some marker bytes, then text."""
    docs = documents(spark, sf_dir, "text", "source", "n_chars")
    content = F.concat(
        F.unhex(F.lit("D0CF11E0A1B11AE1")), F.unhex(F.expr(OLE_TAIL_CASE)), F.encode("text", "UTF-8")
    )
    return docs.select(
        "doc_id",
        "n_chars",
        F.expr(PATH_SQL).alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("bigint").alias("length"),
    )


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of a labelled folder, some without usable content."""
    docs = documents(spark, sf_dir, "text").selectExpr("doc_id", f"encode({CONTENT_SQL}, 'UTF-8') AS content")
    return docs.selectExpr(
        "concat('/in/', doc_id, '.txt') AS path",
        "timestamp_seconds(doc_id + 1704067200) AS modificationTime",
        "cast(octet_length(content) AS bigint) AS length",
        "content",
    )


def results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """A results table: the documents checked with the fixture rules."""
    docs = documents(spark, sf_dir, "text", "source", "n_chars", "lang")
    return docs.select(
        "doc_id",
        F.expr(PATH_SQL).alias("file_path"),
        F.expr(expected_mime(f"lower({EXT_CASE})")).alias("mime_type"),
        F.col("text").alias("content"),
        F.expr(checked("text", RULES, **options)).alias("words"),
        F.expr(ERROR_SQL).alias("error"),
        (F.col("n_chars") / 100.0).alias("processing_time"),
        F.col("n_chars").alias("file_size"),
        (F.col("n_chars") < 400).alias("is_empty"),
        F.expr("lang = 'es'").alias("skipped"),
    )


# ------------------------------------------------------------- packed archives
ZIP_DOCUMENTS = 5000
ZIP_HEAD, ZIP_PLACE, ZIP_END = "<4s2B4HL2L2H", "<4s4B4HL2L5H2L", "<4s4H2LH"


def _zip(entries: list[tuple[str, str]]) -> bytes:
    """The bytes that ``zipfile`` writes, for short lists of small members without its work for each."""
    if len(entries) > 60_000 or sum(len(text) for _, text in entries) > 200 << 20:
        return _zip_any(entries)
    now = time.localtime()
    stamp = (now[3] << 11 | now[4] << 5 | now[5] // 2, (now[0] - 1980) << 9 | now[1] << 5 | now[2])
    out, places, at = [], [], 0
    for name, text in entries:
        raw, data = name.encode("ascii"), text.encode()
        packed = zlib.compress(data, -1, -15)
        shared = (20, 0, 0, 8, *stamp, zlib.crc32(data), len(packed), len(data), len(raw), 0)
        places += [struct.pack(ZIP_PLACE, b"PK\1\2", 20, 3, *shared, 0, 0, 0, 0o600 << 16, at), raw]
        out += [struct.pack(ZIP_HEAD, b"PK\3\4", *shared), raw, packed]
        at += struct.calcsize(ZIP_HEAD) + len(raw) + len(packed)
    n, size = len(entries), sum(map(len, places))
    return b"".join([*out, *places, struct.pack(ZIP_END, b"PK\5\6", 0, 0, n, n, size, at, 0)])


def _zip_any(entries: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries:
            archive.writestr(name, text)
    return out.getvalue()


def _packed(docs: DataFrame, make: Callable[[int, str], tuple]) -> DataFrame:
    """``path, length, content``: what ``make`` gives for each document, a portion at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            values = [[r[0] for r in rows], [len(r[1]) for r in rows], [r[1] for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                rows.append(make(doc_id.as_py(), text.as_py()))
                held += len(rows[-1][1])
                if held >= PORTION:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)
            del batch
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(pack, "path string, length bigint, content binary")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ZIP per document: a text member per line, and members to pass over."""

    def box(doc_id: int, text: str) -> tuple:
        lines = text.split("\n")
        entries = [(f"lines/{i:05d}.txt", line) for i, line in enumerate(lines)]
        entries += [
            ("readme.md", text), ("__MACOSX/._readme.md", "x"), ("../evil.txt", "x"),
            ("img/0.bin", "x" * (int(doc_id) % 7)),
        ]
        return f"/zips/{doc_id}.zip", _zip(entries)

    return _packed(documents(spark, sf_dir, "text"), box)


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, length`` of text files that hold all documents, a line end after each."""
    folder = run_dir(spark, "text-files")
    documents(spark, sf_dir, "text").select("text").write.text(folder)
    return read_binary(spark, folder).select("path", "length")


def zip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, length`` of ZIP files with a text member and a passed-over one per document.

    A file has at most ``ZIP_DOCUMENTS`` documents: whoever writes or reads a
    ZIP holds its directory.
    """
    folder = run_dir(spark, "zip-files")
    named = "/".join([folder, "{}-{}.zip"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs = (doc for batch in batches for doc in zip(batch["doc_id"], batch["text"]))
        for number in count():
            first = next(docs, None)
            if first is None:
                return
            path = named.format(TaskContext.get().partitionId(), number)
            system, inner, _ = open_fs(path)
            system.create_dir(inner.rpartition("/")[0], recursive=True)
            with system.open_output_stream(inner) as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    for doc_id, text in chain([first], islice(docs, ZIP_DOCUMENTS - 1)):
                        archive.writestr(f"docs/{doc_id}.txt", text or "")
                        archive.writestr(f"docs/{doc_id}.dat", text or "")
                length = out.tell()
            yield pd.DataFrame({"path": [path], "length": [length]})

    return checkpointed(documents(spark, sf_dir, "text").mapInPandas(pack, "path string, length bigint"))


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One docx, xlsx or pptx per document, its lines as paragraphs, rows or slides."""
    word_ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    sheet_ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    slide_ns = (
        'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
        'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    )

    def docx(lines: list[str]) -> bytes:
        paras = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
        return _zip([("word/document.xml", f"<w:document {word_ns}><w:body>{paras}</w:body></w:document>")])

    def xlsx(lines: list[str]) -> bytes:
        rows = "".join(
            "<row>"
            + "".join(f'<c t="inlineStr"><is><t>{escape(w)}</t></is></c>' for w in x.split(" "))
            + "</row>"
            for x in lines
        )
        return _zip(
            [
                ("xl/workbook.xml", f'<workbook {sheet_ns}><sheets><sheet name="one"/></sheets></workbook>'),
                ("xl/worksheets/sheet1.xml", f"<worksheet {sheet_ns}><sheetData>{rows}</sheetData></worksheet>"),
            ]
        )

    def pptx(lines: list[str]) -> bytes:
        entries = [("ppt/presentation.xml", f"<p:presentation {slide_ns}/>")]
        for i, x in enumerate(lines):
            text = f"<p:sp><p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody></p:sp>"
            pic = "<p:pic/>" if i % 2 else ""
            entries.append(
                (
                    f"ppt/slides/slide{i + 1}.xml",
                    f"<p:sld {slide_ns}><p:cSld><p:spTree>{text}{pic}</p:spTree></p:cSld></p:sld>",
                )
            )
        return _zip(entries)

    makers = [(".docx", docx), (".xlsx", xlsx), (".pptx", pptx)]

    def office(doc_id: int, text: str) -> tuple:
        ext, make = makers[int(doc_id) % 3]
        return f"/office/{doc_id}{ext}", make(text.split("\n"))

    return _packed(documents(spark, sf_dir, "text"), office)
