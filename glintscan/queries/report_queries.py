"""Report, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.operators import filters, match, report
from glintscan.operators.ordered import running
from glintscan.plans import ledger, sinks
from glintscan.queries.derived import (
    ERROR_SQL,
    EXT_CASE,
    PATH_SQL,
    RULES,
    documents,
    results,
)
from glintscan.queries.file_queries import case_map, lit
from glintscan.queries.match_queries import NESTED_CTE, hits_cte
from glintscan.queries.registry import query
from glintscan.session import run_dir
from glintscan.sources.tables import table
from glintscan.streaming import scans

RES_CTE = f"""{hits_cte()}, {NESTED_CTE},
  a AS (SELECT doc_id, count(*) AS n_terms, CAST(sum(cnt) AS BIGINT) AS total,
    string_agg(term || '(' || cnt || '次)', '; ' ORDER BY ord) AS terms,
    string_agg(term || '(' || cnt || '处)', '; ' ORDER BY ord) AS terms_wide,
    string_agg(term, '; ' ORDER BY ord) AS bare FROM n GROUP BY doc_id),
  r AS (SELECT d.doc_id, {PATH_SQL.replace('doc_id', 'd.doc_id')} AS file_path,
    {case_map(f"lower({EXT_CASE.replace('doc_id', 'd.doc_id')})", fixed.EXTENSION_MIME, lit(fixed.OCTET))} AS mime_type,
    text AS content, {ERROR_SQL} AS error, (n_chars / 100.0)::DOUBLE AS processing_time, n_chars, lang,
    coalesce(a.n_terms, 0) AS n_terms, coalesce(a.total, 0) AS total, a.terms, a.terms_wide, a.bare
    FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id),
  s AS (SELECT *, string_split(file_path, '/')[-1] AS file_name,
    trim(regexp_replace(content, '\\s+', ' ', 'g')) AS flat FROM r)"""
PREVIEW = "CASE WHEN length(flat) > 500 THEN left(flat, 500) || '...' ELSE flat END"


@query(
    "run_summary",
    f"""WITH {RES_CTE} SELECT count(*) AS total_files, count(*) FILTER (n_terms > 0) AS sensitive_files,
    round(count(*) FILTER (n_terms > 0) * 100.0 / count(*), 2)::DOUBLE AS sensitive_percent, count(error) AS error_files,
    round(sum(processing_time), 2) AS total_time, round(sum(processing_time) / count(*), 4) AS avg_time FROM r""",
)
def run_summary(spark, sf_dir):
    return report.run_summary(results(spark, sf_dir))


@query(
    "top_mime",
    f"""SELECT {case_map(f'lower({EXT_CASE})', fixed.EXTENSION_MIME, lit(fixed.OCTET))} AS mime_type, count(*) AS files
    FROM documents GROUP BY 1 ORDER BY files DESC, mime_type LIMIT 10""",
)
def top_mime(spark, sf_dir):
    return report.top_mimes(results(spark, sf_dir))


@query(
    "top_terms",
    f"""WITH {hits_cte()} SELECT term, count(*) AS hits FROM h GROUP BY term ORDER BY hits DESC, term LIMIT 10""",
)
def top_terms(spark, sf_dir):
    return report.top_terms(results(spark, sf_dir))


@query(
    "top_terms_capped",
    f"""WITH {hits_cte('longest')}, {NESTED_CTE} SELECT term, sum(least(cnt, 10))::BIGINT AS hits FROM n
    GROUP BY term ORDER BY hits DESC, term LIMIT 10""",
)
def top_terms_capped(spark, sf_dir):
    return report.top_terms(results(spark, sf_dir, order="longest", cap=10))


@query(
    "table_stats",
    f"""SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS sensitive,
    count(*) FILTER (n_chars < 200) AS with_error FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def table_stats(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(labels, "doc_id", "left")
    return report.table_stats(
        docs.selectExpr("toxic AS is_sensitive", f"coalesce({ERROR_SQL}, '') AS error_message")
    )


@query("terms_text", f"WITH {RES_CTE} SELECT doc_id, terms FROM r WHERE terms IS NOT NULL")
def terms_text(spark, sf_dir):
    found = results(spark, sf_dir).where("size(words) > 0")
    return found.selectExpr("doc_id", f"{report.terms_text('words')} AS terms")


@query(
    "sensitive_detail",
    f"""WITH {RES_CTE} SELECT s.file_name, s.file_path, CAST(n.ord AS BIGINT) AS ord, n.term, n.cnt AS n,
    '[' || replace(n.positions, ',', ', ') || ']' AS positions FROM n JOIN s ON s.doc_id = n.doc_id""",
)
def sensitive_detail(spark, sf_dir):
    rows = report.sensitive_detail(results(spark, sf_dir))
    return rows.withColumns({"ord": F.col("ord").cast("bigint"), "n": F.col("n").cast("bigint")})


@query(
    "recognition_type",
    f"WITH {RES_CTE} SELECT doc_id, CASE WHEN n_terms > 0 THEN '敏感' ELSE '常规' END AS recognition FROM r",
)
def recognition_type(spark, sf_dir):
    return results(spark, sf_dir).selectExpr("doc_id", f"{filters.recognition('words')} AS recognition")


@query(
    "result_projection",
    f"""WITH {RES_CTE} SELECT file_path, file_name, mime_type, {PREVIEW} AS content_preview, n_terms,
    n_terms > 0 AS has_sensitive_content, error, processing_time FROM s""",
)
def result_projection(spark, sf_dir):
    rows = report.result_projection(results(spark, sf_dir))
    return rows.withColumn("n_terms", F.col("n_terms").cast("bigint"))


@query(
    "report_results",
    f"""WITH {RES_CTE} SELECT file_path, file_name, mime_type, CASE WHEN n_terms > 0 THEN '是' ELSE '否' END AS is_sensitive,
    coalesce(terms, '无') AS terms, processing_time, coalesce(error, '') AS error, {PREVIEW} AS preview FROM s""",
)
def report_results(spark, sf_dir):
    return report.report_results(results(spark, sf_dir))


@query(
    "report_content",
    f"""WITH {RES_CTE} SELECT file_path, mime_type, md5(CASE WHEN length(content) > 10000
      THEN left(content, 10000) || {lit(fixed.NOTICE_REPORT_CUT)} ELSE content END) AS content_md5 FROM r""",
)
def report_content(spark, sf_dir):
    rows = report.content_rows(results(spark, sf_dir))
    return rows.selectExpr("file_path", "mime_type", "md5(content) AS content_md5")


@query(
    "csv_report",
    f"""WITH {RES_CTE} SELECT file_path, file_name, mime_type, CASE WHEN n_terms > 0 THEN '是' ELSE '否' END AS is_sensitive,
    coalesce(bare, '') AS terms, processing_time, coalesce(error, '') AS error FROM s""",
)
def csv_report(spark, sf_dir):
    folder = run_dir(spark, "csv-report")
    sinks.write_csv(report.csv_rows(results(spark, sf_dir)), folder)
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(folder)
    return back.selectExpr(
        "file_path", "file_name", "mime_type", "is_sensitive", "coalesce(terms, '') AS terms",
        "cast(processing_time AS double) AS processing_time", "coalesce(error, '') AS error",
    )


@query(
    "json_report",
    f"""WITH {RES_CTE} SELECT file_path, file_name, mime_type, {PREVIEW} AS content_preview, n_terms, total AS n_hits,
    n_terms > 0 AS has_sensitive_content, error FROM s""",
)
def json_report(spark, sf_dir):
    folder = run_dir(spark, "json-report")
    sinks.write_json_report(results(spark, sf_dir), folder)
    schema = (
        "file_path string, file_name string, mime_type string, content_preview string, "
        "sensitive_words array<struct<word:string,positions:array<int>,count:int>>, "
        "has_sensitive_content boolean, error string"
    )
    return spark.read.schema(schema).json(f"{folder}/results").selectExpr(
        "file_path",
        "file_name",
        "mime_type",
        "content_preview",
        "cast(size(sensitive_words) AS bigint) AS n_terms",
        "aggregate(sensitive_words, 0L, (a, w) -> a + w.count) AS n_hits",
        "has_sensitive_content",
        "error",
    )


@query(
    "run_log",
    f"""WITH {RES_CTE} SELECT row_number() OVER (ORDER BY doc_id) AS seq, doc_id, file_name, file_path,
    CASE WHEN n_terms > 0 THEN '敏感' ELSE '常规' END AS recognition, coalesce(terms, '') AS terms,
    processing_time, coalesce(error, '') AS error FROM s""",
)
def run_log(spark, sf_dir):
    return report.run_log(results(spark, sf_dir), ["doc_id"])


@query(
    "run_log_appended",
    """SELECT row_number() OVER (ORDER BY run, doc_id) AS seq, run, doc_id, n_chars FROM
    (SELECT CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS run, doc_id, n_chars FROM documents)""",
)
def run_log_appended(spark, sf_dir):
    docs = documents(spark, sf_dir, "n_chars", "lang").selectExpr(
        "if(lang = 'en', 'a', 'b') AS part", "doc_id", "n_chars"
    )
    log = run_dir(spark, "run-log")
    for run in ("a", "b", "a"):  # the repeated run takes its old numbers
        ledger.append_run(docs.where(F.col("part") == run).drop("part"), ["doc_id"], log, run)
    return ledger.read_log(spark, log).select("seq", "run", "doc_id", "n_chars")


@query(
    "run_log_wide",
    f"""WITH {RES_CTE} SELECT file_path, mime_type, n_chars AS file_size, CASE WHEN n_chars < 400 THEN 'Yes' ELSE 'No' END AS is_empty,
    n_terms, coalesce(terms_wide, '') AS terms, processing_time, CASE WHEN error IS NOT NULL THEN '失败' WHEN n_chars < 400 THEN '空文件'
      WHEN lang = 'es' THEN '已跳过' ELSE '成功' END AS status, coalesce(error, '') AS error FROM r""",
)
def run_log_wide(spark, sf_dir):
    rows = report.run_log_wide(results(spark, sf_dir))
    return rows.withColumn("n_terms", F.col("n_terms").cast("bigint"))


# ------------------------------------------------------- running and streaming
_CENTS = "CAST(round(value * 100) AS BIGINT)"


def _event_totals(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    return running(
        events,
        ["ts", "event_id"],
        {
            "processed": "1L",
            "errors": "CAST(event_type = 'error' AS BIGINT)",
            "cents": _CENTS,
        },
        {"of_type": ("event_type", "1L")},
    )


@query(
    "running_counts",
    f"""SELECT event_id, event_type, count(*) OVER w AS processed,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors,
    CAST(sum({_CENTS}) OVER w AS BIGINT) AS cents,
    count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS of_type
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def running_counts(spark, sf_dir):
    return _event_totals(spark, sf_dir).select(
        "event_id", "event_type", "processed", "errors", "cents", "of_type"
    )


@query(
    "progress_rate",
    f"""WITH p AS (SELECT event_id, count(*) OVER w AS processed, CAST(sum({_CENTS}) OVER w AS BIGINT) / 100.0::DOUBLE AS seconds,
      count(*) OVER () AS total FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, processed, round(processed * 100.0::DOUBLE / total, 4) AS percent_done,
      round(CAST(CAST(seconds / processed AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS mean_seconds,
      round(CAST(CAST(seconds / processed * (total - processed) AS VARCHAR) AS DECIMAL(38, 20)), 2)::DOUBLE AS seconds_left FROM p""",
)
def progress_rate(spark, sf_dir):
    totals = _event_totals(spark, sf_dir).selectExpr("event_id", "processed", "cents / 100D AS seconds")
    total = table(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar()
    return report.progress(totals, "processed", "seconds", total).drop("seconds")


@query(
    "stream_scan",
    f"WITH {hits_cte()}, {NESTED_CTE} SELECT doc_id, kind, term, positions FROM n",
)
def stream_scan(spark, sf_dir):
    folder = run_dir(spark, "stream-scan")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = scans.stream_table(spark, f"{sf_dir}/documents[.]parquet", schema).select("doc_id", "text")
    found = scans.scan_stream(docs, RULES).select("doc_id", "words")
    scans.run_to_end(lambda: scans.append_log(found, f"{folder}/log", f"{folder}/state"))
    return match.explode_words(spark.read.parquet(f"{folder}/log"), ["doc_id"]).select(
        "doc_id", "kind", "term", F.array_join("positions", ",").alias("positions")
    )


@query(
    "stream_counts",
    f"""SELECT event_type, count(*) AS processed, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM events GROUP BY event_type""",
)
def stream_counts(spark, sf_dir):
    folder = run_dir(spark, "stream-counts")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = scans.stream_table(spark, f"{sf_dir}/events[.]parquet", schema)
    counted = scans.counters(
        events, ["event_type"], {"processed": F.count(F.lit(1)), "cents": F.sum(F.expr(_CENTS))}
    )
    scans.run_to_end(lambda: scans.latest_counters(counted, f"{folder}/out", f"{folder}/state"))
    return scans.final_counters(spark, f"{folder}/out")


@query(
    "stream_resume",
    f"""WITH {hits_cte()}, {NESTED_CTE} SELECT d.doc_id, count(n.doc_id) AS n_terms
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def stream_resume(spark, sf_dir):
    folder = run_dir(spark, "stream-resume")
    docs = documents(spark, sf_dir, "text", "lang")
    for arrived in ("lang = 'en'", "lang <> 'en'"):
        # The other files arrive after the first run ended; the second run goes
        # on from the checkpoint of the first.
        docs.where(arrived).write.mode("append").parquet(f"{folder}/in")
        arriving = scans.stream_table(spark, f"{folder}/in", docs.schema, files_per_batch=4)
        found = scans.scan_stream(arriving, RULES).select("doc_id", "words")
        scans.run_to_end(lambda f=found: scans.append_log(f, f"{folder}/log", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/log").selectExpr(
        "doc_id", "cast(size(words) AS bigint) AS n_terms"
    )


@query("stream_files", f"WITH {hits_cte()} SELECT term, count(*) AS hits FROM h GROUP BY term")
def stream_files(spark, sf_dir):
    folder = run_dir(spark, "stream-files")
    documents(spark, sf_dir, "text").select("text").write.text(f"{folder}/in")
    arriving = scans.stream_files(spark, f"{folder}/in").where("endswith(path, '.txt')")
    # The tasks write large files: they are read as blocks of a megabyte.
    found = scans.scan_block_stream(
        arriving.select("path", "length"), RULES, size=1 << 20, overlap=1 << 16, encoding="utf-8"
    )
    scans.run_to_end(lambda: scans.append_log(found, f"{folder}/log", f"{folder}/state"))
    return report.term_totals(spark.read.parquet(f"{folder}/log"))


# Every seventh document stands in a PDF, which gives an error instead of a text.
_PDF = "doc_id % 7 = 0"


@query(
    "stream_scan_counts",
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE NOT {_PDF}), {hits_cte('config', 'd')}
    SELECT 'processed' AS counter, '' AS name, count(*)::BIGINT AS n FROM documents
    UNION ALL SELECT 'errors', '', count(*) FILTER ({_PDF})::BIGINT FROM documents
    UNION ALL SELECT 'empty', '', count(*) FILTER (text = '' AND NOT {_PDF})::BIGINT FROM documents
    UNION ALL SELECT 'skipped', '', 0::BIGINT
    UNION ALL SELECT 'term', term, count(*)::BIGINT FROM h GROUP BY term""",
)
def stream_scan_counts(spark, sf_dir):
    folder = run_dir(spark, "stream-scan-counts")
    docs = documents(spark, sf_dir, "text").selectExpr(
        f"if({_PDF}, concat('/in/', doc_id, '.pdf'), concat('/in/', doc_id, '.txt')) AS path",
        f"encode(if({_PDF}, concat('%PDF', text), text), 'UTF-8') AS content",
    )
    docs.selectExpr("*", "cast(octet_length(content) AS bigint) AS length").write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    arriving = scans.stream_table(spark, f"{folder}/in", schema, files_per_batch=4)
    counted = scans.scan_counters(scans.scan_file_stream(arriving, RULES))
    scans.run_to_end(lambda: scans.latest_counters(counted, f"{folder}/out", f"{folder}/state"))
    return scans.final_counters(spark, f"{folder}/out")
