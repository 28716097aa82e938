"""Text-cleaning, chunking and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintscan.functions import fixed, text
from glintscan.queries.derived import NAME_SQL, PATH_SQL, documents
from glintscan.queries.registry import query
from glintscan.sources.tables import texts

CJK = "一-龥"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clean_sql(t: str, digits: bool = True) -> str:
    d = "0-9" if digits else ""
    return f"array_to_string(regexp_extract_all(lower({t}), '[{CJK}a-zA-Z{d}]+'), ' ')"


def _pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages", "page_id", "html")


@query("token_clean", f"SELECT doc_id, md5({clean_sql('text')}) AS clean_md5 FROM documents")
def token_clean(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"md5({text.token_clean('text')}) AS clean_md5"
    )


@query("token_clean_alpha", f"SELECT doc_id, md5({clean_sql('text', False)}) AS clean_md5 FROM documents")
def token_clean_alpha(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"md5({text.token_clean('text', digits=False)}) AS clean_md5"
    )


CSS = "'/* ' || page_id || ' */ url(a' || page_id || ') var(--x' || page_id || ') ' || html"


def css_sql(t: str) -> str:
    out = f"regexp_replace({t}, '(?s)/\\*.*?\\*/', '', 'g')"
    out = f"regexp_replace({out}, '(?i)url\\([^)]*\\)', '', 'g')"
    out = f"regexp_replace({out}, 'var\\(--[^)]*\\)', '', 'g')"
    return clean_sql(out)


@query("css_clean", f"SELECT page_id, md5({css_sql(CSS)}) AS clean_md5 FROM pages")
def css_clean(spark, sf_dir):
    styled = _pages(spark, sf_dir).selectExpr("page_id", f"{CSS} AS t")
    return styled.selectExpr("page_id", f"md5({text.css_clean('t')}) AS clean_md5")


def unescape_sql(t: str) -> str:
    for name, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        t = f"replace({t}, '{name}', '{char}')"
    return t


@query("html_unescape", f"SELECT page_id, md5({unescape_sql('html')}) AS text_md5 FROM pages")
def html_unescape(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(text.html_unescape("html")).alias("text_md5"))


XML_SQL = clean_sql(unescape_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')"))


@query("xml_clean", f"SELECT page_id, md5({XML_SQL}) AS clean_md5 FROM pages")
def xml_clean(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(text.xml_clean("html")).alias("clean_md5"))


# Well-formed content around the documents: their lines as elements, sections and text after
# elements, with attributes, comments and instructions that are no text.
_ESCAPED = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_LINE_XML = (
    "CASE i % 3 WHEN 0 THEN '<p k=\"shown > not\"><b>' || {e} || '</b></p>' "
    "WHEN 1 THEN '<!-- hidden > <i> --><![CDATA[x > y ' || replace(x, ']]>', ' ') || ']]>' "
    "ELSE '<br/>' || {e} || '<?tool hidden > ?>' END"
)
XML_LINES_SQL = """SELECT doc_id, [CASE (i - 1) % 3 WHEN 1 THEN 'x > y ' || replace(x, ']]>', ' ') ELSE x END
  FOR x, i IN string_split(text, chr(10))] AS lines FROM documents"""


@query(
    "xml_character_data",
    f"""SELECT doc_id, md5({clean_sql(unescape_sql("array_to_string(lines, ' ')"))}) AS clean_md5
    FROM ({XML_LINES_SQL})""",
)
def xml_character_data(spark, sf_dir):
    line = _LINE_XML.format(e=_ESCAPED)
    body = f"array_join(transform(split(text, '\\n', -1), (x, i) -> {line}), ' ')"
    docs = documents(spark, sf_dir, "text").selectExpr("doc_id", f"concat('<d a=\"hidden\">', {body}, '</d>') AS t")
    return docs.select("doc_id", F.md5(text.xml_clean("t")).alias("clean_md5"))


TYPE_CASE = """CASE page_id % 4 WHEN 0 THEN 'application/zip' WHEN 1 THEN 'image/svg+xml'
 WHEN 2 THEN 'text/xml' ELSE 'text/css' END"""


@query(
    "clean_dispatch",
    f"""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN md5({css_sql('html')}) ELSE md5({XML_SQL}) END AS clean_md5 FROM pages""",
)
def clean_dispatch(spark, sf_dir):
    typed = _pages(spark, sf_dir).selectExpr("page_id", "html", f"{TYPE_CASE} AS file_type")
    return typed.select("page_id", F.md5(text.clean_dispatch("html", "file_type")).alias("clean_md5"))


@query(
    "general_clean",
    f"""WITH c AS (SELECT doc_id, {clean_sql("regexp_replace(text, '\\s+', ' ', 'g')", False)} AS t FROM documents)
    SELECT doc_id, md5(t) AS clean_md5 FROM c""",
)
def general_clean(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"md5({text.general_clean('text')}) AS clean_md5"
    )


@query(
    "content_preview",
    """WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, text FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS preview,
      CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS raw_preview FROM c""",
)
def content_preview(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id",
        f"{text.preview('text')} AS preview",
        f"{text.preview('text', collapsed=False)} AS raw_preview",
    )


@query(
    "content_truncate",
    f"""SELECT doc_id, md5(CASE WHEN length(text) > 10000 THEN left(text, 10000) || {lit(fixed.NOTICE_REPORT_CUT)} ELSE text END) AS report_md5,
    md5(CASE WHEN length(text) > 5000 THEN left(text, 5000) || {lit(fixed.NOTICE_CONTENT_CUT)} ELSE text END) AS content_md5 FROM documents""",
)
def content_truncate(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id",
        f"md5({text.truncate('text', 10000, fixed.NOTICE_REPORT_CUT)}) AS report_md5",
        f"md5({text.truncate('text', 5000, fixed.NOTICE_CONTENT_CUT)}) AS content_md5",
    )


_SPECIAL = r"""len(regexp_extract_all(p, '[^\p{L}\p{N} .,;:!?\-"''()\[\]{}<>/\\]'))"""
PARA_CTE = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
    unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
  p0 AS (SELECT doc_id, i, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS p FROM l),
  p AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM p0
    WHERE length(p) >= 20 AND {_SPECIAL} * 1.0::DOUBLE / length(p) <= 0.3::DOUBLE)"""


@query(
    "paragraph_filter",
    f"WITH {PARA_CTE} SELECT doc_id, ord, md5(p) AS para_md5 FROM p",
)
def paragraph_filter(spark, sf_dir):
    paras = documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"posexplode({text.paragraphs('text', separator=chr(10))}) AS (ord, p)"
    )
    return paras.selectExpr("doc_id", "cast(ord AS bigint) AS ord", "md5(p) AS para_md5")


@query(
    "paragraph_budget",
    f"""WITH {PARA_CTE}, t AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id) AS total,
      sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY length(p) DESC, ord) AS used FROM p),
    k AS (SELECT *, CASE WHEN total > 2000 THEN row_number() OVER (PARTITION BY doc_id ORDER BY length(p) DESC, ord) ELSE ord + 1 END AS r
      FROM t WHERE total <= 2000 OR used <= 2000)
    SELECT doc_id, count(*) AS paragraphs, md5(string_agg(p, chr(10) || chr(10) ORDER BY r)) AS text_md5 FROM k GROUP BY doc_id""",
)
def paragraph_budget(spark, sf_dir):
    kept = text.budget_paragraphs(text.paragraphs("text", separator="\n"), 2000)
    fitted = documents(spark, sf_dir, "text").selectExpr("doc_id", f"{kept} AS paras")
    return fitted.where("size(paras) > 0").select(
        "doc_id",
        F.size("paras").cast("bigint").alias("paragraphs"),
        F.md5(F.array_join("paras", "\n\n")).alias("text_md5"),
    )


@query(
    "binary_text",
    f"""WITH {PARA_CTE},
    j AS (SELECT doc_id, count(*) AS n, string_agg(p, chr(10) || chr(10) ORDER BY ord) AS t FROM p GROUP BY doc_id)
    SELECT d.doc_id, 'utf-8' AS encoding, coalesce(n, 0) AS paragraphs, coalesce(length(t), 0) < 100 AS failed,
      md5(CASE WHEN coalesce(length(t), 0) < 100 THEN '' ELSE t END) AS text_md5 FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id""",
)
def binary_text(spark, sf_dir):
    from glintscan.sources.files import binary_text as read_binary_text

    raw = documents(spark, sf_dir, "text").selectExpr("doc_id", "encode(text, 'UTF-8') AS content")
    found = read_binary_text(raw, separator="\n")
    return found.selectExpr(
        "doc_id", "encoding", "cast(paragraphs AS bigint) AS paragraphs",
        "error IS NOT NULL AS failed", "md5(text) AS text_md5",
    )


CTRL = "text || chr(7) || repeat(chr(1), CAST(doc_id % 5 AS INT))"


@query(
    "control_ratio",
    f"SELECT doc_id, round((1 + doc_id % 5) * 1.0::DOUBLE / (length(text) + 1 + doc_id % 5), 8) AS ratio FROM documents",
)
def control_ratio(spark, sf_dir):
    noisy = documents(spark, sf_dir, "text").selectExpr("doc_id", f"{CTRL} AS t")
    return noisy.selectExpr("doc_id", f"round({text.control_share('t')}, 8) AS ratio")


PHRASES = [(r"\bthe ([a-z]+)", "that $1"), (r"([0-9]{4})[0-9]{12}", "card $1"), (r"token = ", "secret: ")]


@query(
    "phrase_rewrite",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\\bthe ([a-z]+)', 'that \\1', 'g'),
      '([0-9]{4})[0-9]{12}', 'card \\1', 'g'), 'token = ', 'secret: ', 'g')) AS text_md5 FROM documents""",
)
def phrase_rewrite(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"md5({text.rewrite_phrases('text', PHRASES)}) AS text_md5"
    )


@query(
    "word_chunks",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS s FROM w)
    SELECT doc_id, s // 64 AS chunk_id, md5(array_to_string(w[s + 1:s + 128], ' ')) AS chunk_md5 FROM c""",
)
def word_chunks(spark, sf_dir):
    chunks = documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"posexplode({text.word_chunks('text', 128)}) AS (chunk_id, c)"
    )
    return chunks.selectExpr("doc_id", "cast(chunk_id AS bigint) AS chunk_id", "md5(c) AS chunk_md5")


WORDS_CTE = """w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
  u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i, w[1] AS first, len(w) AS n FROM w)"""


@query(
    "augment_delete",
    f"""WITH {WORDS_CTE}, k AS (SELECT *, left(md5('42:' || doc_id || ':' || i), 4) >= '3333' AS keep FROM u),
    j AS (SELECT doc_id, max(n) AS n, max(first) AS first, string_agg(word, ' ' ORDER BY i) FILTER (keep) AS t FROM k GROUP BY doc_id)
    SELECT d.doc_id, md5(CASE WHEN coalesce(n, 0) <= 1 THEN text WHEN t IS NULL THEN first ELSE t END) AS text_md5
    FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id""",
)
def augment_delete(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"md5({text.delete_words('text', 'doc_id')}) AS text_md5"
    )


SYNONYMS = {"the": "that", "and": "plus", "les": "des", "der": "die", "token": "key", "ist": "war"}
_SYN = "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYNONYMS.items()) + " ELSE word END"


@query(
    "augment_synonym",
    f"""WITH {WORDS_CTE} SELECT doc_id, md5(string_agg({_SYN}, ' ' ORDER BY i)) AS text_md5 FROM u GROUP BY doc_id""",
)
def augment_synonym(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"md5({text.replace_synonyms('text', SYNONYMS)}) AS text_md5"
    )


@query(
    "augment_mixed",
    f"""WITH {WORDS_CTE}, k AS (SELECT *, left(md5('42:' || doc_id || ':' || i), 4) >= '3333' AS keep FROM u),
    j AS (SELECT doc_id, max(n) AS n, max(first) AS first, string_agg(word, ' ' ORDER BY i) FILTER (keep) AS t,
      string_agg({_SYN}, ' ' ORDER BY i) AS s FROM k GROUP BY doc_id)
    SELECT d.doc_id, md5(CASE WHEN left(md5('42:row:' || d.doc_id), 4) >= '4ccc' THEN text
      WHEN left(md5('42:kind:' || d.doc_id), 4) >= '8000' THEN s
      WHEN n <= 1 THEN text WHEN t IS NULL THEN first ELSE t END) AS text_md5
    FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id""",
)
def augment_mixed(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr(
        "doc_id", f"md5({text.augmented('text', 'doc_id', SYNONYMS)}) AS text_md5"
    )


@query(
    "name_ext",
    f"""WITH n AS (SELECT doc_id, {NAME_SQL} AS name FROM documents)
    SELECT doc_id, name, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS extension FROM n""",
)
def name_ext(spark, sf_dir):
    from glintscan.functions.paths import base_name, suffix

    named = documents(spark, sf_dir, "source").selectExpr("doc_id", f"{PATH_SQL} AS path")
    return named.selectExpr("doc_id", f"{base_name('path')} AS name", f"{suffix('path')} AS extension")


@query(
    "time_format",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, strftime(ts, '%Y-%m-%d %H:%M') AS minute_text FROM events",
)
def time_format(spark, sf_dir):
    from glintscan.sources.tables import table

    return table(spark, sf_dir, "events", "event_id", "ts").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute_text"),
    )
