"""Training-set, classification and end-to-end queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.operators import classify, dataset
from glintscan.plans import scan
from glintscan.queries.derived import (
    CONTENT_SQL,
    RULES,
    archives,
    documents,
    files,
    office_files,
    sample_files,
)
from glintscan.queries.registry import query
from glintscan.queries.text_queries import TYPE_CASE, XML_SQL, css_sql
from glintscan.session import run_dir
from glintscan.sources.tables import inline_table, table, texts


def _hashed(spark, sf_dir):
    return documents(spark, sf_dir, "text").selectExpr("doc_id", "text", "md5(text) AS md5")


@query(
    "dedup_keep_first",
    "SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents GROUP BY md5(text)",
)
def dedup_keep_first(spark, sf_dir):
    return dataset.keep_first(_hashed(spark, sf_dir), "md5", "doc_id").select("doc_id", "md5")


@query(
    "dedup_drop_all",
    "SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents GROUP BY md5(text) HAVING count(*) = 1",
)
def dedup_drop_all(spark, sf_dir):
    return dataset.drop_all_repeats(_hashed(spark, sf_dir), "md5", "doc_id").select("doc_id", "md5")


@query("content_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def content_md5(spark, sf_dir):
    raw = documents(spark, sf_dir, "text").withColumn("content", F.encode("text", "UTF-8"))
    return raw.select("doc_id", dataset.content_md5(F.col("content")).alias("md5"))


@query(
    "duplicate_groups",
    "SELECT md5(text) AS md5, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1",
)
def duplicate_groups(spark, sf_dir):
    return dataset.duplicate_groups(_hashed(spark, sf_dir), "md5")


@query(
    "migrate_clean",
    f"""SELECT page_id, md5(html) AS md5, {TYPE_CASE} AS file_type,
    CASE WHEN page_id % 4 = 3 THEN md5({css_sql('html')}) ELSE md5({XML_SQL}) END AS content_md5 FROM pages""",
)
def migrate_clean(spark, sf_dir):
    source, target = run_dir(spark, "files"), run_dir(spark, "files-clean")
    texts(spark, sf_dir, "pages", "page_id", "html").selectExpr(
        "page_id", "md5(html) AS md5", f"{TYPE_CASE} AS file_type", "html AS content"
    ).write.parquet(source)
    dataset.migrate(spark.read.parquet(source)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).selectExpr(
        "page_id", "md5", "file_type", "md5(content) AS content_md5"
    )


@query(
    "add_status_column",
    """SELECT doc_id AS id, '成功' AS extraction_status FROM documents
    UNION ALL SELECT page_id + 1000000, '提取失败' FROM pages""",
)
def add_status_column(spark, sf_dir):
    old = table(spark, sf_dir, "documents", "doc_id").selectExpr("doc_id AS id")
    new = table(spark, sf_dir, "pages", "page_id").selectExpr(
        "page_id + 1000000 AS id", "'提取失败' AS extraction_status"
    )
    return dataset.add_status(dataset.append_files(old, new))


@query(
    "train_test_split",
    f"""SELECT doc_id, CASE WHEN left(md5('42:' || doc_id), 6) < '{int(0.7 * 16**6):06x}' THEN 'train' ELSE 'test' END AS side
    FROM documents JOIN labels USING (doc_id)""",
)
def train_test_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", "doc_id")
    docs = table(spark, sf_dir, "documents", "doc_id").join(labels, "doc_id")
    return docs.select("doc_id", dataset.split_side(F.col("doc_id")).alias("side"))


# -------------------------------------------------------------- classification
def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("toxic AS label", "1 - quality AS prediction")


@query(
    "confusion_matrix",
    "SELECT toxic AS label, 1 - quality AS prediction, count(*) AS n FROM labels GROUP BY 1, 2",
)
def confusion_matrix(spark, sf_dir):
    return classify.confusion_matrix(_scored(spark, sf_dir))


@query(
    "class_report",
    """WITH s AS (SELECT toxic AS y, 1 - quality AS p FROM labels),
    c AS (SELECT DISTINCT y AS c FROM s UNION SELECT DISTINCT p FROM s),
    k AS (SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS said,
      count(*) FILTER (y = c AND p = c) AS hit FROM c CROSS JOIN s GROUP BY c),
    m AS (SELECT c, support, hit, CASE WHEN said > 0 THEN hit / said ELSE 0 END::DOUBLE AS pr,
      CASE WHEN support > 0 THEN hit / support ELSE 0 END::DOUBLE AS re FROM k),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END::DOUBLE AS f1 FROM m)
    SELECT c::VARCHAR AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM f
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
      round(sum(hit) / sum(support), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""",
)
def class_report(spark, sf_dir):
    return classify.class_report(_scored(spark, sf_dir))


FEATURE_TERMS = ["License", "Copyright", "the", "then", "token", "les", "der", "x"]
FEATURE_PHRASES = ["[0-9]{16}", "license", r"[a-z0-9.]+@[a-z0-9.]+"]
_TERM_PARTS = " UNION ALL ".join(
    f"SELECT '{t}' AS feature, count(*) FILTER (contains(text, '{t}')) AS weight FROM p"
    for t in FEATURE_TERMS
    if len(t) >= 2
)
_PHRASE_PARTS = " UNION ALL ".join(
    f"SELECT '{p}', sum(len(list_filter(regexp_extract_all(text, '(?i){p}'), lambda m: length(m) >= 2)))::BIGINT FROM p"
    for p in FEATURE_PHRASES
)


@query(
    "top_features",
    f"""WITH p AS (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    f AS ({_TERM_PARTS} UNION ALL {_PHRASE_PARTS})
    SELECT feature, weight FROM f WHERE weight > 0 ORDER BY weight DESC, feature LIMIT 10""",
)
def top_features(spark, sf_dir):
    good = table(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1").select("doc_id")
    positives = documents(spark, sf_dir, "text").join(good, "doc_id")
    return classify.top_features(positives, FEATURE_TERMS, FEATURE_PHRASES)


def _samples(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    docs = documents(spark, sf_dir, "text").join(labels, "doc_id")
    rows = docs.selectExpr("doc_id", "text", "cast(quality AS double) AS label")
    return rows.withColumn("side", dataset.split_side(F.col("doc_id")))


def _model(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    return classify.train_classifier(
        rows.where("side = 'train'"),
        rows.where("side = 'test'"),
        reg_params=(0.1, 0.01),
        buckets=1 << 14,
        max_iter=10,
    )


@query("train_classifier")
def train_classifier(spark, sf_dir):
    _, history = _model(spark, sf_dir)
    best = min(loss for _, loss in history)
    rows = [(float(reg), float(loss), loss == best) for reg, loss in history]
    return inline_table(spark, rows, "reg_param double, test_loss double, is_best boolean")


@query("predict_max_chunk")
def predict_max_chunk(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    return classify.predict_max_chunk(model, documents(spark, sf_dir, "text"), "doc_id", size=256)


@query("predict_batch")
def predict_batch(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    return classify.predict(model, documents(spark, sf_dir, "text"))


# ------------------------------------------------------------------ end to end
@query("scan_end_to_end")
def scan_end_to_end(spark, sf_dir):
    inputs = files(spark, sf_dir).select("path", "length", "content")
    inputs = inputs.unionByName(archives(spark, sf_dir)).unionByName(office_files(spark, sf_dir))
    return scan.scan(inputs, RULES, order="longest", cap=10).selectExpr(
        "file_path", "mime_type", "size(words) AS n_terms", "error", "is_empty", "skipped"
    )


@query(
    "sample_table",
    f"""SELECT DISTINCT md5(content) AS md5, strlen(content) AS file_size, 1 AS is_sensitive
    FROM (SELECT {CONTENT_SQL} AS content FROM documents)
    WHERE content <> '' AND content NOT IN ({", ".join(f"'{e}'" for e in fixed.EXTRACTION_ERRORS)})""",
)
def sample_table(spark, sf_dir):
    inputs = sample_files(spark, sf_dir)
    folder = run_dir(spark, "sample-table")
    scan.write_samples(spark, inputs, 1, folder)
    scan.write_samples(spark, inputs, 0, folder)  # all hashes known: adds nothing
    return spark.read.parquet(folder).select("md5", "file_size", "is_sensitive")
