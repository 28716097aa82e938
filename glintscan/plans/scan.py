"""End-to-end plans: scan a folder, build a sample table, report file types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.functions.cols import any_of, case, is_in, let, lit
from glintscan.functions.detect import (
    encoding_guess,
    has_nul,
    header_hex,
    header_mime,
    is_clear,
    is_encrypted,
    is_utf8,
    is_zip,
    mime_cascade,
    report_label,
    with_zip_info,
    zip_info,
    zip_subtype,
)
from glintscan.functions.encoding import charset
from glintscan.functions.inside import IS_ZIP, opened_files
from glintscan.functions.paths import base_name, suffix
from glintscan.functions.search import with_checked
from glintscan.functions.text import markdown_profile, sniff_delimiter
from glintscan.operators import dataset, filters
from glintscan.session import run_dir
from glintscan.sources.archives import SCAN_MEMBERS, all_errors, left_members, odf_text
from glintscan.sources.rules import RuleSet

# Rejects files by size: SQL texts of the length and of whether it is a ZIP to ``error`` or other words.
Gate = Callable[[str, str], str]
OOXML_TYPES = [fixed.DOCX, fixed.XLSX, fixed.PPTX]
ODF_TYPES = [f"application/vnd.oasis.opendocument.{k}" for k in ("text", "spreadsheet", "presentation")]
UNREADABLE = [
    fixed.DOC, fixed.XLS, fixed.PPT, fixed.OLE, "application/pdf", "application/rtf",
    "application/x-rar", "application/x-7z-compressed", "application/gzip",
]


def typed_files(
    files: DataFrame, encrypted_first: bool = False, members: str | None = None, gate: Gate | None = None
) -> DataFrame:
    """Add ``mime_type`` and ``charset`` to ``path, length, content`` rows.

    With ``members`` one Python step also opens each ZIP and decodes what is
    not plain UTF-8: ``box`` has the members with such names, ``inside`` the
    text and encoding of all files that :func:`routed_files` gives a route with
    text (with the same ``gate``). ``charset`` is then only known of files that
    are decoded.
    """
    if members:
        if encrypted_first:
            raise ValueError("encrypted_first is for types alone, without members")
        return _opened(files, members, gate)
    mime = mime_cascade("path", "content", "length", "zip", "charset")
    if encrypted_first:
        mime = f"if({is_encrypted('content', 'zip')}, 'application/encrypted', {mime})"
    known = with_zip_info(files).withColumn("charset", F.expr(charset("content")))
    return known.withColumn("mime_type", F.expr(mime)).drop("zip", "box")


def _opened(files: DataFrame, members: str, gate: Gate | None) -> DataFrame:
    """Type, encoding, members and text of files; what is no ZIP is typed and routed before the step in Python."""
    typed = files.withColumn("__zip", F.expr(f"coalesce({is_zip('content')}, false)"))
    typed = typed.withColumn("__header", F.expr(f"if(__zip, NULL, {header_mime('path', 'content', None)})"))
    # Files of these types are skipped, opened by others or not readable.
    never = is_in("__header", [*OOXML_TYPES, *ODF_TYPES, *UNREADABLE, fixed.ZIP])
    never = f"(__zip OR coalesce({never} OR {filters.skips_mime('__header')}, false))"
    typed = typed.withColumn("charset", F.expr(f"if({never}, NULL, {charset('content')})"))
    mime = mime_cascade("path", "content", "length", None, "charset", "__header")
    typed = typed.withColumn("__mime", F.expr(f"if(__zip, NULL, {mime})"))
    typed = typed.withColumn("__route", F.expr(f"if(__zip, 'zip', {_route('__mime', 'false', gate)})"))
    utf8 = f"charset IN ('utf-8', 'utf-8-sig') AND {is_utf8('content')}"
    plain = f"coalesce(CASE __route WHEN 'text' THEN {utf8} WHEN 'binary' THEN {is_clear('content')} END, false)"
    named = typed.withColumn("__plain", F.expr(plain)).withColumn(
        "__name", F.expr(f"CASE __route WHEN 'zip' THEN '{IS_ZIP}' WHEN 'text' THEN coalesce(charset, 'latin-1') END")
    )
    asked = "if(__route IN ('zip', 'text', 'binary') AND NOT __plain, content, NULL)"
    opened = named.withColumn("__opened", opened_files(asked, "__name", members))
    native = "cast(if(charset = 'utf-8-sig' AND __route = 'text', substring(content, 4), content) AS string)"
    inside = (
        f"if(__plain, struct({native} AS text, coalesce(__name, 'utf-8') AS encoding), "
        "struct(__opened.text AS text, __opened.encoding AS encoding))"
    )
    known = zip_info(opened.withColumns({"box": F.col("__opened.box"), "inside": F.expr(inside)}))
    by_members = mime_cascade("path", "content", "length", "zip", header=f"({zip_subtype('zip')})")
    return known.withColumn("mime_type", F.expr(f"if(__zip, {by_members}, __mime)")).drop(
        "__zip", "__header", "__mime", "__route", "__plain", "__name", "__opened", "zip"
    )


def _skipped(mime: str, damaged: str) -> str:
    # The type of a file whose bytes were not read is unknown.
    named = f"(content IS NOT NULL OR {filters.skips_extension(suffix('path'))})"
    by_name = any_of([f"{filters.skips_mime(mime)} AND NOT {damaged}", filters.skips_extension(suffix("path"))])
    return f"(length > 0 AND {named} AND {by_name})"


def _route(mime: str, damaged: str, gate: Gate | None) -> str:
    too_large = "length > 0 AND content IS NULL"
    if gate is not None:
        too_large = f"({too_large}) OR {gate('length', f'{mime} = {lit(fixed.ZIP)}')} = 'error'"
    return case(
        [
            ("length = 0", "'none'"),
            (too_large, "'too_large'"),
            (_skipped(mime, damaged), "'none'"),
            (damaged, "'archive'"),
            (is_in(mime, OOXML_TYPES), "'ooxml'"),
            (f"{mime} = {lit(fixed.ZIP)}", "'archive'"),
            (is_in(mime, UNREADABLE), "'unreadable'"),
            (is_in(mime, ODF_TYPES), "'odf'"),
            (f"charset IS NULL AND {has_nul('content')}", "'binary'"),
        ],
        "'text'",
    )


def routed_files(typed: DataFrame, gate: Gate | None = None) -> DataFrame:
    """Add ``is_empty``, ``skipped`` and the ``route`` of each file.

    No file is too large unless a ``gate`` (``filters.size_gate`` for the
    original's limits) says so or its bytes were not read.
    A damaged ZIP has no type; it goes to its error, not to the skipped files.
    """
    damaged = "coalesce(exists(box, m -> m.member IS NULL), false)" if "box" in typed.columns else "false"
    return typed.withColumns(
        {
            "is_empty": F.expr("length = 0"),
            "skipped": F.expr(_skipped("mime_type", damaged)),
            "route": F.expr(_route("mime_type", damaged, gate)),
        }
    )


def extracted(routed: DataFrame) -> DataFrame:
    """Add ``text``, ``encoding``, ``error`` and ``left`` to routed files, in one pass without a shuffle.

    Text files are decoded by their encoding; other files with zero bytes
    take the decoding with most printable text; Office and archive texts come
    from their members (all of them as ``inside``). ``box`` has an error for
    each member that cannot be read; the readable ones count all the same. The
    other routes give no text. ``left`` names the members of an archive that are
    not searched.
    """
    text = case(
        [
            ("route = 'text'", "inside.text"),
            ("route IN ('binary', 'ooxml', 'archive')", "coalesce(inside.text, '')"),
            ("route = 'odf'", f"coalesce({odf_text('box', 'mime_type')}, '')"),
        ],
        "''",
    )
    error = case(
        [
            ("route = 'too_large'", filters.too_large_text("length")),
            ("route = 'unreadable'", "concat('不支持的文件类型: ', mime_type)"),
            ("route IN ('ooxml', 'odf', 'archive') AND box IS NULL", "'解压缩失败: 不是ZIP文件'"),
            ("route IN ('ooxml', 'odf', 'archive')", all_errors("box")),
        ]
    )
    encoding = case([("route IN ('text', 'binary')", "inside.encoding")])
    return routed.withColumns(
        {
            "text": F.expr(text),
            "encoding": F.expr(encoding),
            "error": F.expr(error),
            "left": F.expr(f"if(route = 'archive', {left_members('box')}, NULL)"),
        }
    ).drop("box", "inside", "charset")


def file_metadata(ext: str, mime: str, text: str, encoding: str) -> str:
    """What is known of a file as a map of texts (SQL text).

    ``file_type`` and ``encoding``; for CSV files ``delimiter``, ``rows`` (lines
    with text after the first) and ``columns`` (of the first line, quotes not
    read); for Markdown files the counts of headers, code blocks, links and
    images.
    """
    csv = f"({ext} = '.csv' OR {mime} = 'text/csv') AND {encoding} IS NOT NULL"
    lines = f"greatest(regexp_count({text}, {lit(r'(?m)^.*[^\s].*$')}) - 1, 0)"
    first = f"substring_index({text}, {lit(chr(10))}, 1)"
    columns = "length(fl) - length(replace(fl, dl, '')) + 1"
    table = let(
        first,
        "fl",
        let(
            sniff_delimiter(text),
            "dl",
            f"map('delimiter', dl, 'rows', cast({lines} AS string), 'columns', cast({columns} AS string))",
        ),
    )
    markdown = f"({ext} IN ('.md', '.markdown') OR {mime} = 'text/markdown') AND {encoding} IS NOT NULL"
    names = ("headers", "code_blocks", "links", "images")
    counts = let(
        markdown_profile(text), "mp", f"map({', '.join(f'{lit(n)}, cast(mp.{n} AS string)' for n in names)})"
    )
    empty = "cast(map() AS map<string, string>)"
    base = f"map_filter(map('file_type', {mime}, 'encoding', {encoding}), (k, v) -> v IS NOT NULL)"
    return f"map_concat({base}, {case([(csv, table), (markdown, counts)], empty)})"


def scan(
    files: DataFrame, rules: RuleSet, order: str = "config", gate: Gate | None = None, **options
) -> DataFrame:
    """Files to results: type, text, nested words, flags, errors and metadata.

    With a ``gate`` files that it rejects get an error instead of a text. Files
    over a cell and members over what a row may hold have an error here and are
    searched by :mod:`glintscan.sources.blocks`. ``metadata`` names the members
    of an archive that are not searched (``skipped_members``).

    ``mime_mismatch``: the extension promises another type than the detected
    one; ``header_warning``: an Office extension without its container's header.
    """
    texts = extracted(routed_files(typed_files(files, members=SCAN_MEMBERS, gate=gate), gate))
    return with_checked(texts, "text", "words", rules, order=order, **options).selectExpr(
        "path AS file_path",
        "mime_type",
        "length AS file_size",
        "text AS content",
        "words",
        "error",
        "is_empty",
        "skipped",
        f"map_concat({file_metadata(suffix('path'), 'mime_type', 'text', 'encoding')}, "
        "if(size(left) > 0, map('skipped_members', array_join(left, ', ')), cast(map() AS map<string, string>))) AS metadata",
        f"NOT is_empty AND {filters.mime_mismatch(suffix('path'), 'mime_type')} AS mime_mismatch",
        f"if(is_empty, NULL, {filters.header_warning(suffix('path'), 'content')}) AS header_warning",
    )


def type_labels(files: DataFrame) -> DataFrame:
    """Signature report rows: path, type label, size, header."""
    known = with_zip_info(files).withColumn("encoding", encoding_guess("content"))
    return known.selectExpr(
        "path AS file_path",
        f"{report_label('path', 'content', 'length', 'zip', 'encoding')} AS type",
        "length AS size",
        f"{header_hex('content', 16)} AS header_hex",
        "cast(NULL AS string) AS error",
    )


def sample_rows(files: DataFrame, flag: int, gate: Gate | None = None) -> DataFrame:
    """Inventory rows to ``files`` rows with a constant label, failures dropped."""
    texts = extracted(routed_files(typed_files(files, members=SCAN_MEMBERS, gate=gate), gate))
    failed = lit(fixed.EXTRACTION_ERRORS[0])
    rows = texts.selectExpr(
        "path AS id",
        "md5(content) AS md5",
        f"{base_name('path')} AS filename",
        "mime_type AS file_type",
        "length AS file_size",
        "date_format(modificationTime, 'yyyy-MM-dd HH:mm:ss') AS created_time",
        f"if(error IS NOT NULL, {failed}, text) AS content",
        f"{int(flag)} AS is_sensitive",
    )
    return filters.drop_failed(rows)


def write_samples(spark: SparkSession, files: DataFrame, flag: int, table: str) -> None:
    """Append a labelled folder to a Parquet sample table, new hashes only.

    The extracted rows are written once; deduplication then reads narrow
    columns of that table instead of extracting again.
    """
    staged_at = run_dir(spark, "samples")
    sample_rows(files, flag).write.parquet(staged_at)
    fresh = dataset.keep_first(spark.read.parquet(staged_at))
    try:
        known = spark.read.parquet(table).select("md5")
    except AnalysisException:  # first folder: no table yet
        known = None
    if known is not None:
        fresh = fresh.join(known, "md5", "left_anti")
    fresh.write.mode("append").parquet(table)


def load_samples(spark: SparkSession, table: str) -> DataFrame:
    """Training samples of a Parquet table: ``content, is_sensitive`` only."""
    return spark.read.parquet(table).select("content", "is_sensitive")


def load_samples_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same samples from a database table Spark can reach over JDBC."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return reader.load().select("content", "is_sensitive")
