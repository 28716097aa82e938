"""Source, filter and type-detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintscan.functions import detect, fixed, paths, text
from glintscan.functions.cols import lit as spark_lit
from glintscan.functions.detect import signature_table
from glintscan.operators import filters, report
from glintscan.plans import scan, sinks
from glintscan.queries.derived import (
    CONTENT_SQL,
    ERROR_SQL,
    EXT_CASE,
    FILES_CTE,
    NAME_SQL,
    OLE_CTE,
    PATH_SQL,
    archives,
    documents,
    files,
    office_files,
    ole_files,
    sample_files,
)
from glintscan.queries.registry import query
from glintscan.session import run_dir
from glintscan.sources import archives as archive_source
from glintscan.functions.encoding import with_text
from glintscan.sources import delimited, sheets
from glintscan.sources import files as file_source
from glintscan.sources.tables import table


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def case_map(key: str, mapping: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {key} {arms} ELSE {default} END)"


def any_sql(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


MIME_BY_EXT = case_map("ext", fixed.EXTENSION_MIME, lit(fixed.OCTET))
SKIP_MIME_SQL = any_sql(
    [f"mime IN {in_list(fixed.SKIP_MIMES)}"]
    + [f"starts_with(mime, {lit(p)})" for p in fixed.SKIP_MIME_PREFIXES]
)
TYPED_CTE = FILES_CTE + f", t AS (SELECT *, {MIME_BY_EXT} AS mime FROM f)"


# --------------------------------------------------------------------- sources
def _lines_of(scanned, origin: str):
    """``origin`` and the hash of each line of scanned text files."""
    lines = "split(cast(content AS string), '\\n', -1)"
    return scanned.selectExpr(
        f"{origin} AS origin", f"explode(slice({lines}, 1, size({lines}) - 1)) AS line"
    ).selectExpr("origin", "md5(line) AS line_md5")


def _write_texts(df, folder: str, *parts: str) -> None:
    df.write.option("maxRecordsPerFile", 1000).mode("append").partitionBy(*parts).text(folder)


@query(
    "file_scan",
    """SELECT lang AS origin, md5(unnest(string_split(text, chr(10)))) AS line_md5 FROM documents""",
)
def file_scan(spark, sf_dir):
    folder = run_dir(spark, "file-scan")
    _write_texts(documents(spark, sf_dir, "text", "lang").select("text", "lang"), folder, "lang")
    return _lines_of(file_source.scan_files(spark, folder), f"regexp_extract(path, {spark_lit('/lang=([^/]*)/')}, 1)")


@query(
    "scan_names",
    f"""WITH {FILES_CTE} SELECT doc_id, path FROM f WHERE NOT (starts_with(name, '.')
    OR starts_with(name, '~$') OR path LIKE '%/.hid/%' OR starts_with(name, '[5]')
    OR starts_with(name, '__substg1.0_') OR ext IN {in_list(fixed.SKIP_EXTENSIONS)})""",
)
def scan_names(spark, sf_dir):
    docs = documents(spark, sf_dir, "source").selectExpr("doc_id", f"{PATH_SQL} AS path")
    return docs.where(file_source.wanted("path"))


@query(
    "internal_stream_filter",
    f"""WITH {FILES_CTE} SELECT doc_id, name,
    regexp_matches(name, {lit(fixed.INTERNAL_STREAM_PATTERN)}) AS is_internal FROM f""",
)
def internal_stream_filter(spark, sf_dir):
    named = documents(spark, sf_dir).selectExpr("doc_id", f"{NAME_SQL} AS name")
    return named.selectExpr("doc_id", "name", f"{paths.is_internal_stream('name')} AS is_internal")


@query(
    "file_metadata",
    f"""WITH {FILES_CTE} SELECT path, name AS file_name, CASE WHEN ext <> '' THEN ext WHEN starts_with(name, '__substg') THEN '.0_' || doc_id ELSE '' END AS extension,
    length(hx) // 2 AS file_size, left(hx, 64) AS header_hex,
    strftime(make_timestamp((1704067200 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified_at FROM f""",
)
def file_metadata(spark, sf_dir):
    stamped = files(spark, sf_dir).withColumn(
        "modificationTime", F.timestamp_seconds(F.col("doc_id") + 1704067200)
    )
    return file_source.file_metadata(stamped)


@query("header_hex", f"WITH {FILES_CTE} SELECT doc_id, left(hx, 64) AS header_hex FROM f")
def header_hex(spark, sf_dir):
    return files(spark, sf_dir).selectExpr(
        "doc_id", f"{detect.header_hex('content')} AS header_hex"
    )


@query(
    "text_read_truncate",
    f"""SELECT doc_id, length(text) > 2000 AS was_cut,
    md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || {lit(fixed.NOTICE_FILE_CUT)} ELSE text END)
      AS text_md5 FROM documents""",
)
def text_read_truncate(spark, sf_dir):
    raw = documents(spark, sf_dir, "text").selectExpr(
        "doc_id", "length(text) > 2000 AS was_cut", "encode(text, 'UTF-8') AS content"
    )
    return file_source.read_text(raw, 2000).selectExpr("doc_id", "was_cut", "md5(text) AS text_md5")


_COUNTS = ", ".join(
    f"length(s) - length(replace(s, {d}, '')) AS c{i}" for i, d in enumerate(["','", "';'", "chr(9)", "'|'"])
)


@query(
    "csv_delimiter_sniff",
    f"""WITH s AS (SELECT doc_id, left(text, 4096) AS s FROM documents),
    c AS (SELECT doc_id, {_COUNTS} FROM s),
    m AS (SELECT *, greatest(c0, c1, c2, c3) AS m FROM c)
    SELECT doc_id, CASE WHEN m < 5 THEN ',' WHEN c0 = m THEN ',' WHEN c1 = m THEN ';'
      WHEN c2 = m THEN chr(9) ELSE '|' END AS delimiter FROM m""",
)
def csv_delimiter_sniff(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"{text.sniff_delimiter('text')} AS delimiter"
    )


@query(
    "csv_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, {n} AS is_numeric, (SELECT count(*) FROM part) AS rows"
        for c, t, n in [
            ("p_partkey", "int64", "true"), ("p_name", "object", "false"), ("p_brand", "object", "false"),
            ("p_type", "object", "false"), ("p_size", "int64", "true"), ("p_retailprice", "float64", "true"),
        ]
    ),
)
def csv_profile(spark, sf_dir):
    folder = run_dir(spark, "csv-profile")
    sinks.write_csv(table(spark, sf_dir, "part"), folder, sep="|")
    return delimited.column_profile(delimited.read_delimited(spark, folder, rows=None))


@query(
    "load_samples",
    "SELECT md5(d.text) AS content_md5, l.toxic AS is_sensitive FROM documents d JOIN labels l USING (doc_id)",
)
def load_samples(spark, sf_dir):
    folder = run_dir(spark, "samples")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    rows = table(spark, sf_dir, "documents", "doc_id", "text").join(labels, "doc_id")
    rows.selectExpr("doc_id AS id", "text AS content", "toxic AS is_sensitive").write.parquet(folder)
    return scan.load_samples(spark, folder).selectExpr("md5(content) AS content_md5", "is_sensitive")


@query(
    "labelled_ingest",
    f"""SELECT DISTINCT md5(content) AS md5, 1 AS is_sensitive FROM (SELECT {CONTENT_SQL} AS content FROM documents)
    WHERE content <> '' AND content NOT IN {in_list(fixed.EXTRACTION_ERRORS)}""",
)
def labelled_ingest(spark, sf_dir):
    from glintscan.operators import dataset

    kept = dataset.keep_first(scan.sample_rows(sample_files(spark, sf_dir), 1))
    return kept.select("md5", "is_sensitive")


@query(
    "multi_path_scan",
    """SELECT 'documents' AS origin, md5(unnest(string_split(text, chr(10)))) AS line_md5 FROM documents UNION ALL
    SELECT 'conversations', md5(unnest(string_split(text, chr(10)))) FROM conversations UNION ALL
    SELECT 'benchmark', md5(unnest(string_split(text, chr(10)))) FROM benchmark""",
)
def multi_path_scan(spark, sf_dir):
    folder = run_dir(spark, "multi-path")
    names = ("documents", "conversations", "benchmark")
    for name in names:
        texts = table(spark, sf_dir, name, "text").select("text")
        texts.write.option("maxRecordsPerFile", 1000).text(f"{folder}/{name}")
    scanned = file_source.scan_files(spark, [f"{folder}/{name}" for name in names])
    return _lines_of(scanned, f"regexp_extract(path, {spark_lit('/([^/]*)/[^/]*$')}, 1)")


_MEMBERS_CTE = """l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
    unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
  m AS (SELECT doc_id, 'readme.md' AS member, 0 AS depth, text AS body, '.md' AS ext FROM documents
    UNION ALL SELECT doc_id, 'lines/' || lpad(i::VARCHAR, 5, '0') || '.txt', 1, line, '.txt' FROM l
    UNION ALL SELECT doc_id, 'img/0.bin', 1, repeat('x', (doc_id % 7)::INT), '.bin' FROM documents
    UNION ALL SELECT doc_id, '__MACOSX/._readme.md', 1, 'x', '.md' FROM documents),
  k AS (SELECT *, strlen(body) AS size, CASE WHEN member LIKE '\\_\\_MACOSX%' ESCAPE '\\' THEN 'skipped'
      WHEN ext <> '.bin' AND trim(body) <> '' THEN 'text' ELSE 'binary' END AS kind FROM m)"""


@query(
    "archive_members",
    f"""WITH {_MEMBERS_CTE} SELECT '/zips/' || doc_id || '.zip' AS path, member, depth, ext AS extension,
    size, kind, CASE WHEN kind = 'text' THEN md5(body) END AS preview_md5 FROM k""",
)
def archive_members(spark, sf_dir):
    return archive_source.archive_members(archives(spark, sf_dir)).selectExpr(
        "path", "member", "depth", "extension", "size", "kind", "md5(preview) AS preview_md5"
    )


@query(
    "archive_stats",
    f"""WITH {_MEMBERS_CTE} SELECT '/zips/' || doc_id || '.zip' AS path, count(*) AS total_files,
    max(depth) AS max_depth, count(*) FILTER (kind = 'text') AS text_files,
    count(*) FILTER (kind = 'binary') AS binary_files, count(*) FILTER (kind = 'skipped') AS skipped_files
    FROM k GROUP BY doc_id""",
)
def archive_stats(spark, sf_dir):
    return archive_source.archive_stats(archive_source.archive_members(archives(spark, sf_dir)))


@query(
    "archive_extensions",
    f"""WITH {_MEMBERS_CTE} SELECT ext AS extension, count(*) AS files FROM k GROUP BY ext
    ORDER BY files DESC, ext LIMIT 10""",
)
def archive_extensions(spark, sf_dir):
    members = archive_source.archive_members(archives(spark, sf_dir))
    return archive_source.archive_extensions(members)


@query(
    "ooxml_text",
    """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
    SELECT '/office/' || doc_id || '.docx' AS path, 'docx' AS file_type, 1 AS part,
      md5(array_to_string(lines, chr(10) || chr(10))) AS text_md5, len(lines)::INT AS rows FROM l WHERE doc_id % 3 = 0
    UNION ALL SELECT '/office/' || doc_id || '.xlsx', 'xlsx', 1, md5(array_to_string(
      list_transform(lines, lambda x: replace(x, ' ', chr(9))), chr(10))), len(lines)::INT FROM l WHERE doc_id % 3 = 1
    UNION ALL SELECT '/office/' || doc_id || '.pptx', 'pptx', i::INT, md5(trim(line)), NULL
      FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM l WHERE doc_id % 3 = 2)""",
)
def ooxml_text(spark, sf_dir):
    return archive_source.ooxml_parts(office_files(spark, sf_dir)).selectExpr(
        "path", "file_type", "part", "md5(text) AS text_md5", "rows"
    )


@query(
    "slide_stats",
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 3 = 2)
    SELECT '/office/' || doc_id || '.pptx' AS path, len(lines) AS slides,
      len(list_filter(lines, lambda x: trim(x) <> '')) AS slides_with_content,
      len(lines) + len(lines) // 2 AS total_shapes, len(lines) // 2 AS total_images,
      0::BIGINT AS total_charts, 0::BIGINT AS total_tables FROM l""",
)
def slide_stats(spark, sf_dir):
    return archive_source.slide_stats(archive_source.ooxml_parts(office_files(spark, sf_dir)))


@query(
    "sheet_slice",
    """SELECT p_name, p_brand, p_type FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part)
    WHERE r BETWEEN 5 AND 1500 AND p_brand <> 'Brand#2'""",
)
def sheet_slice(spark, sf_dir):
    return sheets.sheet_slice(
        table(spark, sf_dir, "part"), ["p_partkey"], rows="5:1500", columns="B:D", query="p_brand <> 'Brand#2'"
    )


@query(
    "sheet_slice_deep",
    """SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r FROM lineitem)
    WHERE r BETWEEN 20001 AND 45000""",
)
def sheet_slice_deep(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem", *keys)
    rows = sheets.pick_rows(lines, "20001:45000", keys)
    return rows.select("l_orderkey", "l_partkey")


@query(
    "sheet_merge",
    """SELECT p_partkey AS id, p_name AS name, NULL::DOUBLE AS balance, 'part' AS sheet_name FROM part
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_acctbal, 'customer' FROM customer""",
)
def sheet_merge(spark, sf_dir):
    return sheets.merge_sheets(
        {
            "part": table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS name"),
            "supplier": table(spark, sf_dir, "supplier").selectExpr(
                "s_suppkey AS id", "s_name AS name", "s_acctbal AS balance"
            ),
            "customer": table(spark, sf_dir, "customer").selectExpr(
                "c_custkey AS id", "c_name AS name", "c_acctbal AS balance"
            ),
        }
    ).select("id", "name", "balance", "sheet_name")


@query(
    "sheet_stats",
    """WITH s AS (SELECT 'part' AS sheet_name, count(*) AS rows, 6::BIGINT AS columns FROM part UNION ALL
      SELECT 'supplier', count(*), 4 FROM supplier UNION ALL SELECT 'orders', count(*), 6 FROM orders),
    t AS (SELECT *, rows * columns AS cells FROM s)
    SELECT * FROM t UNION ALL SELECT '*', sum(rows)::BIGINT, sum(columns)::BIGINT, sum(cells)::BIGINT FROM t""",
)
def sheet_stats(spark, sf_dir):
    return sheets.sheet_stats({n: table(spark, sf_dir, n) for n in ("part", "supplier", "orders")})


@query("sheet_export", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def sheet_export(spark, sf_dir):
    folder = run_dir(spark, "sheet")
    sheet = table(spark, sf_dir, "supplier")
    sinks.export_sheet(sheet, folder, "txt")
    return spark.read.schema(sheet.schema).option("header", True).option("sep", "\t").csv(folder)


@query(
    "row_cap",
    """SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER
      (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS r
      FROM lineitem) WHERE r <= 5000""",
)
def row_cap(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", *keys)
    return sheets.cap_rows(lines, ["l_returnflag"], keys, 5000).select(
        "l_returnflag", "l_orderkey", "l_linenumber"
    )


MD_SQL = "'# ' || source || chr(10) || replace(text, chr(10), chr(10) || '## ') || ' ```x``` [a](b) ![c](d)'"


@query(
    "markdown_profile",
    f"""WITH m AS (SELECT doc_id, {MD_SQL} AS t FROM documents)
    SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{{1,6}}\\s+')) AS headers,
      len(regexp_extract_all(t, '```')) // 2 AS code_blocks,
      len(regexp_extract_all(t, '\\[.*?\\]\\(.*?\\)')) AS links,
      len(regexp_extract_all(t, '!\\[.*?\\]\\(.*?\\)')) AS images FROM m""",
)
def markdown_profile(spark, sf_dir):
    md = documents(spark, sf_dir, "text", "source").selectExpr("doc_id", f"{MD_SQL.replace('chr(10)', 'char(10)')} AS t")
    return md.selectExpr("doc_id", f"{text.markdown_profile('t')} AS p").selectExpr("doc_id", "p.*").select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("headers", "code_blocks", "links", "images")]
    )


# --------------------------------------------------------------------- filters
@query(
    "skip_extension",
    f"WITH {FILES_CTE} SELECT doc_id, ext FROM f WHERE ext NOT IN {in_list(fixed.SKIP_EXTENSIONS)}",
)
def skip_extension(spark, sf_dir):
    named = documents(spark, sf_dir).selectExpr("doc_id", f"lower({EXT_CASE}) AS ext")
    return named.where(f"NOT {filters.skips_extension('ext')}")


@query("skip_mime", f"WITH {TYPED_CTE} SELECT doc_id, mime, {SKIP_MIME_SQL} AS skipped FROM t")
def skip_mime(spark, sf_dir):
    typed = _typed(spark, sf_dir)
    return typed.selectExpr("doc_id", "mime", f"{filters.skips_mime('mime')} AS skipped")


def _typed(spark, sf_dir):
    docs = documents(spark, sf_dir, "n_chars")
    return docs.selectExpr(
        "doc_id", "n_chars", f"{paths.expected_mime(f'lower({EXT_CASE})')} AS mime"
    )


@query(
    "empty_flag",
    f"""WITH c AS (SELECT doc_id, {CONTENT_SQL} AS content FROM documents)
    SELECT doc_id, strlen(content) AS length, content = '' AS is_empty FROM c""",
)
def empty_flag(spark, sf_dir):
    sized = _contents(spark, sf_dir).selectExpr("doc_id", "cast(octet_length(content) AS bigint) AS length")
    return sized.selectExpr("doc_id", "length", "length = 0 AS is_empty")


@query(
    "size_gate",
    f"""WITH {TYPED_CTE} SELECT doc_id, CASE WHEN mime = 'application/zip' AND n_chars * 20000 > 104857600 THEN 'error'
    WHEN n_chars * 20000 > 209715200 THEN 'error' WHEN n_chars * 20000 > 52428800 THEN 'warn' ELSE 'ok' END AS gate FROM t""",
)
def size_gate(spark, sf_dir):
    gate = filters.size_gate("n_chars * 20000", "mime = 'application/zip'")
    return _typed(spark, sf_dir).selectExpr("doc_id", f"{gate} AS gate")


@query(
    "unsupported_type",
    f"WITH {TYPED_CTE} SELECT doc_id, mime, "
    + any_sql(f"starts_with(mime, {lit(p)})" for p in fixed.UNSUPPORTED_PREFIXES)
    + " AS unsupported FROM t",
)
def unsupported_type(spark, sf_dir):
    return _typed(spark, sf_dir).selectExpr(
        "doc_id", "mime", f"{filters.is_unsupported('mime')} AS unsupported"
    )


def _contents(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr("doc_id", f"{CONTENT_SQL} AS content")


@query(
    "drop_failed",
    f"""WITH c AS (SELECT doc_id, {CONTENT_SQL} AS content FROM documents)
    SELECT doc_id, md5(content) AS content_md5 FROM c WHERE content <> '' AND content NOT IN {in_list(fixed.EXTRACTION_ERRORS)}""",
)
def drop_failed(spark, sf_dir):
    return filters.drop_failed(_contents(spark, sf_dir)).selectExpr("doc_id", "md5(content) AS content_md5")


@query(
    "drop_failed_substring",
    f"""WITH c AS (SELECT doc_id, {CONTENT_SQL} AS content FROM documents)
    SELECT doc_id, md5(content) AS content_md5 FROM c WHERE content <> '' AND NOT contains(content, '提取失败')
      AND NOT contains(content, '不支持的文件类型')""",
)
def drop_failed_substring(spark, sf_dir):
    kept = filters.drop_failed(_contents(spark, sf_dir), by_substring=True)
    return kept.selectExpr("doc_id", "md5(content) AS content_md5")


@query(
    "keep_failed_status",
    f"""WITH c AS (SELECT doc_id, {CONTENT_SQL} AS content FROM documents)
    SELECT doc_id, CASE WHEN starts_with(content, '提取失败') THEN content ELSE '成功' END AS extraction_status,
      md5(CASE WHEN starts_with(content, '提取失败') THEN '' ELSE content END) AS content_md5 FROM c""",
)
def keep_failed_status(spark, sf_dir):
    return filters.keep_failed(_contents(spark, sf_dir)).selectExpr(
        "doc_id", "extraction_status", "md5(content) AS content_md5"
    )


@query(
    "status_label",
    f"""SELECT doc_id, CASE WHEN n_chars < 200 THEN '失败' WHEN n_chars < 400 THEN '空文件'
    WHEN lang = 'es' THEN '已跳过' ELSE '成功' END AS status FROM documents""",
)
def status_label(spark, sf_dir):
    label = filters.status(ERROR_SQL, "n_chars < 400", "lang = 'es'")
    return documents(spark, sf_dir, "n_chars", "lang").selectExpr("doc_id", f"{label} AS status")


@query(
    "header_warning",
    f"""WITH {FILES_CTE} SELECT doc_id, '文件头不符合 ' || ext || ' 格式' AS warning FROM f
    WHERE (ext IN ('.ppt', '.doc') AND left(hx, 8) <> 'D0CF11E0') OR (ext IN ('.pptx', '.xlsx') AND left(hx, 8) <> '504B0304')""",
)
def header_warning(spark, sf_dir):
    warned = files(spark, sf_dir).selectExpr(
        "doc_id", f"{filters.header_warning(f'lower({EXT_CASE})', 'content')} AS warning"
    )
    return warned.where("warning IS NOT NULL")


# ------------------------------------------------------------------- detection
# The first 4,096 bytes, less those of a character that the cut would split.
_ON = "IN ('8', '9', 'A', 'B')"
_HEAD = f"""left(hx, CASE WHEN length(hx) <= 8192 OR NOT substr(hx, 8193, 1) {_ON} THEN 8192
     WHEN NOT substr(hx, 8191, 1) {_ON} THEN 8190 WHEN NOT substr(hx, 8189, 1) {_ON} THEN 8188 ELSE 8186 END)"""
HEAD_CTE = FILES_CTE + f""", g AS (SELECT *, try(decode(unhex({_HEAD}))) AS t4 FROM f)"""


def text_format_sql(t: str, ext: str) -> str:
    bare = f"trim({t}, ' ' || chr(9) || chr(10) || chr(13))"
    commas = f"(length({t}) - length(replace({t}, ',', '')))"
    lines = f"(length({t}) - length(replace({t}, chr(10), '')))"
    return f"""CASE WHEN {t} IS NULL THEN NULL
      WHEN {ext} = '.json' OR (starts_with({bare}, '{{') AND ends_with({bare}, '}}')) THEN 'application/json'
      WHEN {ext} = '.xml' OR (starts_with({bare}, '<') AND ends_with({bare}, '>')) THEN 'text/xml'
      WHEN ({ext} = '.csv' OR (contains({t}, ',') AND contains({t}, chr(10)))) AND {commas} > 0 AND {lines} > 0
        AND {commas} * 1.0 / {lines} > 1 THEN 'text/csv'
      WHEN {ext} = '.md' OR contains({t}, '##') OR contains({t}, '```') THEN 'text/markdown'
      WHEN {ext} IN ('.yml', '.yaml') OR (contains({t}, ':') AND contains({t}, chr(10))) THEN 'application/yaml'
      ELSE 'text/plain' END"""


# A name such as ".123" has no suffix.
_EXT = "CASE WHEN name = '.' || doc_id THEN '' ELSE ext END"
_OLE16 = "left(hx, 32768)"


def _hx_has(hx: str, marker_hex: str) -> str:
    return f"regexp_matches({hx}, '^(?:..)*?{marker_hex}')"


def _txt_has(hx: str, word: str) -> str:
    return _hx_has(hx, word.encode().hex().upper())


def ole_subtype_sql(hx: str, ext: str) -> str:
    return f"""CASE WHEN {ext} = '.doc' THEN '{fixed.DOC}' WHEN {ext} = '.xls' THEN '{fixed.XLS}' WHEN {ext} = '.ppt' THEN '{fixed.PPT}'
      WHEN {_txt_has(hx, 'WordDocument')} OR {_txt_has(hx, 'Microsoft Word')} THEN '{fixed.DOC}'
      WHEN {_txt_has(hx, 'Workbook')} OR {_txt_has(hx, 'Microsoft Excel')} THEN '{fixed.XLS}'
      WHEN {_txt_has(hx, 'PowerPoint Document')} OR {_txt_has(hx, 'Microsoft PowerPoint')} THEN '{fixed.PPT}'
      WHEN {_txt_has(hx, 'Standard Jet DB')} OR {_txt_has(hx, 'Excel.Sheet')} THEN '{fixed.XLS}'
      ELSE '{fixed.OLE}' END"""


@query(
    "mime_cascade",
    f"""WITH {HEAD_CTE} SELECT doc_id, coalesce(CASE
      WHEN starts_with(hx, '25504446') THEN 'application/pdf' WHEN starts_with(hx, 'FFD8FF') THEN 'image/jpeg'
      WHEN starts_with(hx, '89504E47') THEN 'image/png' WHEN starts_with(hx, '47494638') THEN 'image/gif'
      WHEN starts_with(hx, '424D') THEN 'image/bmp' WHEN starts_with(hx, '494433') OR starts_with(hx, 'FFFB') THEN 'audio/mpeg'
      WHEN starts_with(hx, '52494646') AND contains(left(hx, 64), '57415645') THEN 'audio/wav'
      WHEN starts_with(hx, '00000020667479704D3441') THEN 'video/mp4'
      WHEN starts_with(hx, '504B0304') THEN NULL
      WHEN starts_with(hx, 'D0CF11E0A1B11AE1') THEN {ole_subtype_sql(_OLE16, _EXT)}
      WHEN starts_with(hx, '526172') THEN 'application/x-rar' WHEN starts_with(hx, '377ABCAF') THEN 'application/x-7z-compressed'
      WHEN starts_with(hx, '1F8B08') THEN 'application/gzip' END,
      {text_format_sql('t4', f'({_EXT})')}, {MIME_BY_EXT.replace('CASE ext', f'CASE {_EXT}')}) AS mime_type FROM g""",
)
def mime_cascade(spark, sf_dir):
    return scan.typed_files(files(spark, sf_dir)).select("doc_id", "mime_type")


@query(
    "mime_mismatch",
    f"""WITH {HEAD_CTE}, d AS (SELECT doc_id, {_EXT} AS ext, t4, {text_format_sql('t4', "''")} AS mime FROM g),
    e AS (SELECT *, {case_map('ext', fixed.EXTENSION_MIME)} AS named FROM d)
    SELECT doc_id, ext, mime FROM e WHERE mime IS NOT NULL AND coalesce(named, mime) <> mime""",
)
def mime_mismatch(spark, sf_dir):
    found = files(spark, sf_dir).selectExpr(
        "doc_id",
        f"{paths.suffix('path')} AS ext",
        f"{detect.text_mime(spark_lit(''), 'content')} AS mime",
    )
    return found.where(f"mime IS NOT NULL AND {filters.mime_mismatch('ext', 'mime')}")


@query(
    "text_format",
    f"""WITH s AS (SELECT page_id, html AS h, '' AS ext FROM pages
      UNION ALL SELECT doc_id + 1000000, text, '' FROM documents)
    SELECT page_id, {text_format_sql('h', 'ext')} AS format FROM s""",
)
def text_format(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "html AS h")
    docs = documents(spark, sf_dir, "text").selectExpr("doc_id + 1000000 AS page_id", "text AS h")
    return pages.unionByName(docs).selectExpr(
        "page_id", f"{detect.text_format(spark_lit(''), 'h')} AS format"
    )


_SIG = " ".join(f"WHEN starts_with(left(hx, 64), {lit(p)}) THEN {lit(p)}" for _, p, _ in signature_table() if "\x01" not in p)


@query(
    "signature_match",
    f"""WITH {FILES_CTE}, s AS (SELECT doc_id, CASE {_SIG} END AS signature FROM f)
    SELECT doc_id, signature, {case_map('signature', {p: l for _, p, l in signature_table() if chr(1) not in p})} AS label
    FROM s WHERE signature IS NOT NULL""",
)
def signature_match(spark, sf_dir):
    found = files(spark, sf_dir).selectExpr(
        "doc_id", f"{detect.signature_match(detect.header_hex('content'))} AS signature"
    )
    return found.where("signature IS NOT NULL").selectExpr(
        "doc_id", "signature", f"{detect.signature_label('signature')} AS label"
    )


@query("ext_lookup", f"WITH {TYPED_CTE} SELECT doc_id, ext, mime FROM t")
def ext_lookup(spark, sf_dir):
    named = documents(spark, sf_dir).selectExpr("doc_id", f"lower({EXT_CASE}) AS ext")
    return named.selectExpr("doc_id", "ext", f"{paths.expected_mime('upper(ext)')} AS mime")


_LAST_EXT = {m: e for e, m in fixed.EXTENSION_MIME.items()}


@query(
    "mime_to_ext",
    f"WITH {TYPED_CTE} SELECT doc_id, mime, {case_map('mime', _LAST_EXT, lit('.bin'))} AS extension FROM t",
)
def mime_to_ext(spark, sf_dir):
    return _typed(spark, sf_dir).selectExpr(
        "doc_id", "mime", f"{paths.mime_extension('mime')} AS extension"
    )


@query(
    "ole_subtype",
    f"WITH {OLE_CTE} SELECT doc_id, {ole_subtype_sql(_OLE16, _EXT.replace('name', 'string_split(path, chr(47))[-1]'))} AS mime FROM o",
)
def ole_subtype(spark, sf_dir):
    return ole_files(spark, sf_dir).selectExpr(
        "doc_id", f"{detect.ole_subtype('path', 'content')} AS mime"
    )


_WIDE = " ".join(
    f"WHEN {any_sql(_txt_has(_OLE16, w) for w in words)} THEN {lit(mime)}" for mime, words in fixed.OLE_WIDE_MARKERS
)
_OEXT = f"({_EXT.replace('name', 'string_split(path, chr(47))[-1]')})"


@query(
    "ole_subtype_wide",
    f"""WITH {OLE_CTE} SELECT doc_id, coalesce({case_map(_OEXT, fixed.OLE_EXTENSIONS_WIDE)}, CASE {_WIDE}
      WHEN {_txt_has(_OLE16, 'Slide')} OR {_txt_has(_OLE16, 'PowerPoint')} THEN '{fixed.PPT}' ELSE '{fixed.DOC}' END) AS mime FROM o""",
)
def ole_subtype_wide(spark, sf_dir):
    return ole_files(spark, sf_dir).selectExpr(
        "doc_id", f"{detect.ole_subtype_wide('path', 'content', 'length')} AS mime"
    )


def _score_sql(kind: str) -> str:
    h32 = "left(hx, 65536)"
    sector = "substr(hx, 1025, 256)"
    at_start, anywhere = fixed.OLE_SECTOR_MARKS[kind]
    tests = [f"starts_with({sector}, '{m}')" for m in at_start] + [_hx_has(sector, m) for m in anywhere]
    often = " AND ".join(
        f"len(list_filter(regexp_extract_all(left(hx, 8192), '..'), lambda x: x = '{b:02X}')) > {n}"
        for b, n in fixed.OLE_BYTE_COUNTS[kind]
    )
    found = " + ".join(f"({_hx_has(h32, m)})::INT" for m in fixed.OLE_SCORE_MARKERS[kind])
    pats = any_sql(_hx_has(h32, m) for m in fixed.OLE_SCORE_PATTERNS[kind])
    return f"({found} + CASE WHEN {pats} THEN 2 ELSE 0 END + CASE WHEN {any_sql(tests)} THEN 3 ELSE 0 END + CASE WHEN {often} THEN 1 ELSE 0 END)"


@query(
    "ole_score",
    f"""WITH {OLE_CTE}, s AS (SELECT doc_id, {_OEXT} AS ext, {_score_sql('word')} AS word, {_score_sql('excel')} AS excel,
      {_score_sql('ppt')} AS ppt FROM o),
    b AS (SELECT *, greatest(word, excel, ppt) AS best FROM s),
    n AS (SELECT *, CASE WHEN word = best THEN '{fixed.OLE_SCORE_LABELS['word']}' WHEN excel = best THEN '{fixed.OLE_SCORE_LABELS['excel']}'
      ELSE '{fixed.OLE_SCORE_LABELS['ppt']}' END AS nm FROM b)
    SELECT doc_id, word::INT AS word, excel::INT AS excel, ppt::INT AS ppt, CASE WHEN best >= 2 THEN nm WHEN best > 0 THEN '可能是' || nm || ' (置信度低)'
      WHEN ext = '.doc' THEN '{fixed.OLE_SCORE_LABELS['word']} (基于文件扩展名)' WHEN ext = '.xls' THEN '{fixed.OLE_SCORE_LABELS['excel']} (基于文件扩展名)'
      WHEN ext = '.ppt' THEN '{fixed.OLE_SCORE_LABELS['ppt']} (基于文件扩展名)' ELSE '{fixed.OLE_UNKNOWN_LABEL}' END AS label FROM n""",
)
def ole_score(spark, sf_dir):
    scored = ole_files(spark, sf_dir).selectExpr(
        "doc_id", f"{paths.suffix('path')} AS ext", f"{detect.ole_scores('content')} AS scores"
    )
    return scored.selectExpr("doc_id", "scores.*", f"{detect.ole_score_label('scores', 'ext')} AS label")


@query(
    "zip_subtype",
    """SELECT '/office/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.xlsx' ELSE '.pptx' END AS path,
      'application/vnd.openxmlformats-officedocument.' || CASE doc_id % 3 WHEN 0 THEN 'wordprocessingml.document'
      WHEN 1 THEN 'spreadsheetml.sheet' ELSE 'presentationml.presentation' END AS mime_type FROM documents
    UNION ALL SELECT '/zips/' || doc_id || '.zip', 'application/zip' FROM documents""",
)
def zip_subtype(spark, sf_dir):
    both = office_files(spark, sf_dir).unionByName(archives(spark, sf_dir))
    return detect.with_zip_info(both).selectExpr("path", f"{detect.zip_subtype('zip')} AS mime_type")


@query(
    "riff_subtype",
    f"""WITH {FILES_CTE} SELECT doc_id, CASE substr(hx, 17, 8) WHEN '57454250' THEN 'WebP图像 (.webp)'
      WHEN '57415645' THEN 'WAV音频 (.wav)' WHEN '41564920' THEN 'AVI视频 (.avi)' END AS riff_type
    FROM f WHERE starts_with(hx, '52494646')""",
)
def riff_subtype(spark, sf_dir):
    found = files(spark, sf_dir).selectExpr("doc_id", f"{detect.riff_subtype('content')} AS riff_type")
    return found.where("riff_type IS NOT NULL")


@query(
    "printable_ratio",
    f"""WITH {FILES_CTE}, b AS (SELECT doc_id, unnest(regexp_extract_all(left(hx, 8192), '..')) AS b FROM f),
    r AS (SELECT doc_id, count(*) FILTER (b BETWEEN '20' AND '7E') * 1.0::DOUBLE / count(*) AS ratio,
      count(*) FILTER (b = '00') > 0 AS has_nul, count(*) FILTER (b >= '80') * 1.0::DOUBLE / count(*) AS high
      FROM b GROUP BY doc_id)
    SELECT doc_id, round(ratio, 6) AS ratio, has_nul, CASE WHEN ratio > 0.75 AND NOT has_nul THEN '可能是不带BOM的文本文件 (高可打印字符比例)'
      WHEN ratio > 0.3 AND has_nul THEN '可能是包含二进制数据的数据文件' ELSE '未知二进制文件' END AS label,
      has_nul OR high > 0.3 AS is_binary FROM r""",
)
def printable_ratio(spark, sf_dir):
    profiled = files(spark, sf_dir).selectExpr(
        "doc_id", f"{detect.printable_profile('content')} AS p"
    )
    return profiled.selectExpr(
        "doc_id",
        "round(p.ratio, 6) AS ratio",
        "p.has_nul AS has_nul",
        f"{detect.printable_label('p')} AS label",
        f"{detect.is_binary('p')} AS is_binary",
    )


@query(
    "encrypted_flag",
    f"""WITH {FILES_CTE}, {OLE_CTE}, a AS (SELECT doc_id, 0 AS src, hx FROM f UNION ALL SELECT doc_id, 1, hx FROM o)
    SELECT doc_id, src, contains(left(hx, 64), '8CBAD9FF0ADA') OR contains(left(hx, 64), '52617221')
      OR (starts_with(hx, 'D0CF11E0A1B11AE1') AND ({_txt_has('left(hx, 8192)', 'EncryptedPackage')} OR {_txt_has('left(hx, 8192)', 'EncryptionInfo')}))
      OR starts_with(hx, '504B0304') AS encrypted FROM a""",
)
def encrypted_flag(spark, sf_dir):
    plain = files(spark, sf_dir).selectExpr("doc_id", "0 AS src", "content")
    both = plain.unionByName(ole_files(spark, sf_dir).selectExpr("doc_id", "1 AS src", "content"))
    return detect.with_zip_info(both).selectExpr(
        "doc_id", "src", f"{detect.is_encrypted('content', 'zip')} AS encrypted"
    )


# UTF-8 texts, GBK bytes before plain letters, and a byte that neither form has.
_CODED = "CASE doc_id % 3 WHEN 0 THEN {utf8} WHEN 1 THEN unhex('C3DCC2EB') || {plain} ELSE unhex('FF') || {plain} END"


@query(
    "encoding_guess",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'GBK' ELSE 'unknown' END AS encoding FROM documents""",
)
def encoding_guess(spark, sf_dir):
    plain = f"encode(regexp_replace(text, {spark_lit(r'[^\x00-\x7F]')}, ''), 'UTF-8')"
    coded = _CODED.format(utf8="encode(text, 'UTF-8')", plain=plain)
    raw = documents(spark, sf_dir, "text").selectExpr("doc_id", f"{coded} AS content")
    return raw.withColumn("encoding", detect.encoding_guess("content")).drop("content")


_ENCODED = [
    ("utf-8", "encode(text, 'UTF-8')"),
    ("utf-8-sig", "concat(unhex('EFBBBF'), encode(text, 'UTF-8'))"),
    ("utf-16", "concat(unhex('FFFE'), encode(text, 'UTF-16LE'))"),
    ("utf-16", "concat(unhex('FEFF'), encode(text, 'UTF-16BE'))"),
    ("utf-16-le", "encode(text, 'UTF-16LE')"),
    ("utf-16-be", "encode(text, 'UTF-16BE')"),
    # A phrase in GBK before the ASCII part of the text, which has to be checked to its end.
    ("gb18030", "concat(unhex('BBFAC3DCCEC4BCFE'), encode(regexp_replace(text, '[^\\\\x00-\\\\x7F]', ''), 'UTF-8'))"),
]


@query(
    "charset_detect",
    f"""WITH c AS (SELECT doc_id, doc_id % {len(_ENCODED)} AS k, CASE WHEN doc_id % {len(_ENCODED)} = 6
      THEN '机密文件' || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') ELSE text END AS text FROM documents)
    SELECT doc_id, CASE WHEN text = '' AND k IN (4, 5) THEN 'utf-8' {" ".join(f"WHEN k = {i} THEN '{n}'" for i, (n, _) in enumerate(_ENCODED))} END AS encoding,
      md5(text) AS text_md5 FROM c""",
)
def charset_detect(spark, sf_dir):
    arms = " ".join(f"WHEN {i} THEN {made}" for i, (_, made) in enumerate(_ENCODED))
    raw = documents(spark, sf_dir, "text").selectExpr("doc_id", f"CASE doc_id % {len(_ENCODED)} {arms} END AS content")
    return with_text(raw, "content", "t").selectExpr("doc_id", "t.encoding", "md5(t.text) AS text_md5")


def _count_sql(hx: str, word: str) -> str:
    return f"(length({hx}) - length(replace({hx}, {lit(word)}, ''))) // {len(word)}"


_V = "left(text, 32768)"
_OG = {
    k: " + ".join(_count_sql(_V, w) for w in words) for k, words in fixed.OFFICE_COUNT_WORDS.items()
}


def _guess_arm(kind: str) -> str:
    part, packed, legacy = fixed.OFFICE_GUESS_LABELS[kind]
    return f"WHEN {kind} = best THEN CASE WHEN contains(v, '{part}') OR contains(v, 'Content_Types') THEN '{packed}' ELSE '{legacy}' END"


@query(
    "office_guess",
    f"""WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Microsoft Word ' WHEN 1 THEN 'Sheet Excel xl/workbook.xml'
        WHEN 2 THEN 'Slide Slide PowerPoint ' WHEN 3 THEN 'Office ' ELSE '' END || text AS text FROM documents),
    s AS (SELECT doc_id, {_V} AS v, {", ".join(f"{e} AS {k}" for k, e in _OG.items())} FROM x),
    b AS (SELECT *, greatest(doc, xls, ppt) AS best FROM s)
    SELECT doc_id, CASE WHEN NOT {any_sql(f"contains(v, {lit(w)})" for w in fixed.OFFICE_GATE_WORDS)} THEN NULL
      WHEN best = 0 THEN '{fixed.OFFICE_GUESS_UNKNOWN}' {_guess_arm('doc')} {_guess_arm('xls')} {_guess_arm('ppt')} END AS label FROM b""",
)
def office_guess(spark, sf_dir):
    marked = documents(spark, sf_dir, "text").selectExpr(
        "doc_id",
        """encode(CASE doc_id % 5 WHEN 0 THEN 'Microsoft Word ' WHEN 1 THEN 'Sheet Excel xl/workbook.xml'
        WHEN 2 THEN 'Slide Slide PowerPoint ' WHEN 3 THEN 'Office ' ELSE '' END || text, 'UTF-8') AS content""",
    )
    return marked.selectExpr("doc_id", f"{detect.office_guess('content')} AS label")


# ------------------------------------------------------------ signature report
_LABEL_SQL = f"""CASE WHEN ext = '' THEN '未知二进制文件' ELSE coalesce({case_map('ext', fixed.EXTENSION_LABELS)},
  '未知文件类型 (扩展名: ' || ext || ')') || ' (基于文件扩展名)' END"""


@query("type_labels")
def type_labels(spark, sf_dir):
    return scan.type_labels(files(spark, sf_dir)).select("file_path", "type", "size", "header_hex")


def _labelled(spark, sf_dir):
    from glintscan.functions.cols import lookup

    ext = f"lower({EXT_CASE})"
    named = f"coalesce({lookup(ext, fixed.EXTENSION_LABELS)}, concat('未知文件类型 (扩展名: ', {ext}, ')'))"
    label = f"if({ext} = '', '未知二进制文件', concat({named}, ' (基于文件扩展名)'))"
    return documents(spark, sf_dir, "n_chars").selectExpr(
        "doc_id", "n_chars AS size", f"{label} AS type", f"{ERROR_SQL} AS error"
    )


_L_CTE = f"l AS (SELECT doc_id, n_chars AS size, {_LABEL_SQL} AS type, {ERROR_SQL} AS error FROM (SELECT *, lower({EXT_CASE}) AS ext FROM documents))"


@query(
    "type_filter",
    f"""WITH {_L_CTE} SELECT doc_id, type, {any_sql(f"contains(type, {lit(w)})" for w in fixed.OFFICE_TYPE_WORDS)} AS is_office
    FROM l WHERE {any_sql(f"contains(type, {lit(w)})" for w in fixed.OFFICE_TYPE_WORDS)} OR contains(lower(type), 'json') OR contains(lower(type), 'zip')""",
)
def type_filter(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    office = filters.is_office_label("type")
    wanted = filters.label_matches("type", ["JSON", "zip "])
    return rows.where(f"{office} OR {wanted}").selectExpr("doc_id", "type", f"{office} AS is_office")


@query(
    "type_report",
    f"""WITH {_L_CTE} SELECT type, count(*) AS files, round(count(*) * 100.0 / sum(count(*)) OVER (), 2)::DOUBLE AS percent,
    sum(size)::BIGINT AS bytes, round(sum(size) / count(*), 2)::DOUBLE AS mean_bytes FROM l GROUP BY type""",
)
def type_report(spark, sf_dir):
    return report.type_report(_labelled(spark, sf_dir))


@query(
    "detect_counts",
    f"""WITH {_L_CTE} SELECT count(*) AS total, count(*) - count(error) - count(*) FILTER (starts_with(type, '未知')) AS recognised,
    count(*) FILTER (starts_with(type, '未知')) AS unknown, count(error) AS errors FROM l""",
)
def detect_counts(spark, sf_dir):
    return report.detect_counts(_labelled(spark, sf_dir))

