"""Matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintscan.functions import fixed
from glintscan.operators import dictionary, match, report
from glintscan.queries.derived import RULES, documents, text_files, zip_files
from glintscan.queries.registry import query
from glintscan.sources import blocks
from glintscan.sources.rules import rules_from_dict
from glintscan.sources.tables import table


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans_sql(pattern: str, source: str = "documents", keys: str = "doc_id", text: str = "text") -> str:
    """SELECT of (keys, term, i, pos) for one pattern, positions by window sum."""
    p, g = lit(pattern), lit(f"({pattern})")
    return f"""(SELECT {keys}, term, i,
      sum(length(gap) + length(term)) OVER (PARTITION BY {keys} ORDER BY i) - length(term) AS pos
    FROM (SELECT {keys}, unnest(toks) AS term, unnest(gaps[1:len(toks)]) AS gap,
            unnest(range(1, len(toks) + 1)) AS i
          FROM (SELECT {keys}, regexp_extract_all({text}, {g}, 1) AS toks,
                  string_split_regex({text}, {p}) AS gaps FROM {source})))"""


def flat(words: list[str]) -> str:
    return "|".join(words)


CONFIG_ORDER = flat(RULES.keywords)
LONGEST = flat(sorted(RULES.keywords, key=len, reverse=True))
RULE_LIST = [("structured", p) for p in RULES.structured] + [("number", p) for p in RULES.numbers]


def label(kind: str, p: str) -> str:
    cut = p if len(p) <= 30 else p[:30] + "..."
    return f"{fixed.LABEL_STRUCTURED if kind == 'structured' else fixed.LABEL_NUMBER}[{cut}]"


def hits_cte(order: str = "config", source: str = "documents", keys: str = "doc_id",
             text: str = "text", labelled: bool = False) -> str:
    """CTE h(keys, kind, term, ko, ro, i, pos) of the full check."""
    words = CONFIG_ORDER if order == "config" else LONGEST
    parts = [
        f"SELECT {keys}, 'keyword' AS kind, term, 0 AS ko, 0 AS ro, i, pos FROM "
        + spans_sql(words, source, keys, text)
    ]
    for n, (kind, p) in enumerate(RULE_LIST):
        shown = lit(label(kind, p) if labelled else p)
        ko = 1 if kind == "structured" else 2
        parts.append(
            f"SELECT {keys}, '{kind}', {shown}, {ko}, {n}, i, pos FROM "
            + spans_sql(p, source, keys, text)
        )
    return "h AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


# Per (doc, term): number of hits, first position and place in the nested list.
NESTED_CTE = """n AS (SELECT doc_id, kind, term, count(*) AS cnt, min(pos) AS p0,
  row_number() OVER (PARTITION BY doc_id ORDER BY ko, ro, min(pos)) - 1 AS ord,
  array_to_string(list(CAST(pos AS BIGINT) ORDER BY pos), ',') AS positions
  FROM h GROUP BY doc_id, kind, term, ko, ro)"""


@query(
    "kw_overlapping",
    f"""WITH kw AS (SELECT * FROM (VALUES {", ".join(f"({i}, {lit(w)})" for i, w in enumerate([*RULES.keywords, "ene", "the"]))}) t(ord, term)),
    u AS (SELECT doc_id, unnest(string_split(text, '')) AS c,
      unnest(range(0, length(text))) AS pos FROM documents),
    w AS (SELECT doc_id, pos, {" || ".join(f"coalesce(lead(c, {k}) OVER o, '')" for k in range(9))} AS s
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, ord, term, CAST(pos AS BIGINT) AS pos FROM w JOIN kw
      ON left(s, 1) = left(term, 1) AND starts_with(s, term)""",
)
def kw_overlapping(spark, sf_dir):
    rules = type(RULES)(
        marks=RULES.marks,
        categories={**RULES.categories, "more": (["ene", "the"], 0.5)},
    )
    found = match.overlapping_hits(documents(spark, sf_dir, "text"), rules, ["doc_id"])
    return found.select("doc_id", "ord", "term", F.col("pos").cast("bigint").alias("pos"))


@query(
    "kw_config_order",
    f"SELECT doc_id, term, CAST(pos AS BIGINT) AS pos FROM {spans_sql(CONFIG_ORDER)}",
)
def kw_config_order(spark, sf_dir):
    found = match.hits(documents(spark, sf_dir, "text"), RULES, ["doc_id"], kinds=("keyword",))
    return found.select("doc_id", "term", F.col("pos").cast("bigint").alias("pos"))


@query(
    "kw_longest_first",
    f"""SELECT doc_id, term, CAST(pos AS BIGINT) AS pos FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY pos) AS r
      FROM {spans_sql(LONGEST)}) WHERE r <= 10""",
)
def kw_longest_first(spark, sf_dir):
    found = match.hits(
        documents(spark, sf_dir, "text"), RULES, ["doc_id"], order="longest", cap=10, kinds=("keyword",)
    )
    return found.select("doc_id", "term", F.col("pos").cast("bigint").alias("pos"))


def _rules_sql(kind: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT doc_id, {lit(label(k, p))} AS term, CAST(pos AS BIGINT) AS pos
        FROM {spans_sql(p)} WHERE i <= 10"""
        for k, p in RULE_LIST
        if k == kind
    )


@query("structured_rules", _rules_sql("structured"))
def structured_rules(spark, sf_dir):
    return _regex_rules(spark, sf_dir, "structured")


@query("number_rules", _rules_sql("number"))
def number_rules(spark, sf_dir):
    return _regex_rules(spark, sf_dir, "number")


def _regex_rules(spark, sf_dir, kind):
    docs = documents(spark, sf_dir, "text")
    found = match.hits(docs, RULES, ["doc_id"], cap=10, labelled=True, kinds=(kind,))
    return found.select("doc_id", "term", F.col("pos").cast("bigint").alias("pos"))


@query(
    "check_content",
    f"WITH {hits_cte()} SELECT doc_id, kind, term, CAST(pos AS BIGINT) AS pos FROM h",
)
def check_content(spark, sf_dir):
    found = match.hits(documents(spark, sf_dir, "text"), RULES, ["doc_id"])
    return found.select("doc_id", "kind", "term", F.col("pos").cast("bigint").alias("pos"))


@query(
    "check_turns",
    f"""WITH {hits_cte('longest', 'conversations', 'conv_id, turn')}
    SELECT conv_id, turn, kind, term, CAST(pos AS BIGINT) AS pos FROM h""",
)
def check_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    found = match.hits(turns, RULES, ["conv_id", "turn"], order="longest")
    return found.select("conv_id", "turn", "kind", "term", F.col("pos").cast("bigint").alias("pos"))


@query(
    "nested_hits",
    f"""WITH {hits_cte('longest', labelled=True)}, {NESTED_CTE}
    SELECT doc_id, CAST(ord AS BIGINT) AS ord, kind, term, least(cnt, 10) AS n,
      array_to_string((string_split(positions, ','))[1:10], ',') AS positions FROM n""",
)
def nested_hits(spark, sf_dir):
    found = match.with_words(
        documents(spark, sf_dir, "text"), RULES, order="longest", cap=10, labelled=True
    )
    return match.explode_words(found, ["doc_id"]).select(
        "doc_id",
        F.col("ord").cast("bigint").alias("ord"),
        "kind",
        "term",
        F.col("n").cast("bigint").alias("n"),
        F.array_join("positions", ",").alias("positions"),
    )


CHUNK = {"threshold": 3000, "width": 1500, "step": 1200}


def chunks_cte(threshold: int, width: int, step: int) -> str:
    return f"""c AS (SELECT doc_id, 0 AS start, text AS chunk FROM documents WHERE length(text) <= {threshold}
    UNION ALL SELECT doc_id, CAST(s AS INT), substr(text, CAST(s AS INT) + 1, {width}) FROM
      (SELECT doc_id, text, unnest(range(0, length(text), {step})) AS s FROM documents
       WHERE length(text) > {threshold}))"""


@query(
    "char_chunks",
    f"""WITH {chunks_cte(**CHUNK)} SELECT doc_id, CAST(start AS BIGINT) AS start,
    length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM c""",
)
def char_chunks(spark, sf_dir):
    chunks = match.char_chunks(documents(spark, sf_dir, "text"), ["doc_id"], **CHUNK)
    return chunks.select(
        "doc_id",
        F.col("start").cast("bigint").alias("start"),
        F.length("chunk").cast("bigint").alias("n_chars"),
        F.md5("chunk").alias("chunk_md5"),
    )


@query(
    "chunked_check",
    f"""WITH {chunks_cte(**CHUNK)}, {hits_cte('longest', 'c', 'doc_id, start', 'chunk')},
    u AS (SELECT DISTINCT doc_id, kind, term, CAST(pos + start AS BIGINT) AS pos FROM h)
    SELECT doc_id, kind, term, array_to_string((list(pos ORDER BY pos))[1:10], ',') AS positions
    FROM u GROUP BY doc_id, kind, term""",
)
def chunked_check(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    found = match.chunked_words(docs, RULES, ["doc_id"], cap=10, order="longest", **CHUNK)
    return found.select(
        "doc_id", "kind", "term", F.array_join("positions", ",").alias("positions")
    )


@query(
    "gated_check",
    f"""WITH {hits_cte()}, {NESTED_CTE},
    s AS (SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT s.doc_id, CASE WHEN n.doc_id IS NULL THEN 'model' ELSE n.kind END AS kind,
      CASE WHEN n.doc_id IS NULL THEN {lit(fixed.MODEL_MARKER)} ELSE n.term END AS term,
      coalesce(n.positions, '0') AS positions
    FROM s JOIN documents d USING (doc_id) LEFT JOIN n ON n.doc_id = s.doc_id""",
)
def gated_check(spark, sf_dir):
    said = table(spark, sf_dir, "labels", "doc_id", "toxic").withColumnRenamed("toxic", "prediction")
    gated = match.gated_check(documents(spark, sf_dir, "text"), RULES, said, "doc_id")
    return match.explode_words(gated, ["doc_id"]).select(
        "doc_id", "kind", "term", F.array_join("positions", ",").alias("positions")
    )


@query(
    "model_only_check",
    f"""SELECT d.doc_id, 'model' AS kind, {lit(fixed.MODEL_MARKER)} AS term, '0' AS positions
    FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1""",
)
def model_only_check(spark, sf_dir):
    said = table(spark, sf_dir, "labels", "doc_id", "toxic")
    docs = documents(spark, sf_dir).join(said, "doc_id")
    found = docs.withColumn("words", match.model_only_words(F.col("toxic") == 1))
    return match.explode_words(found, ["doc_id"]).select(
        "doc_id", "kind", "term", F.array_join("positions", ",").alias("positions")
    )


@query(
    "checker_stats",
    f"""WITH {hits_cte()} SELECT count(*) AS check_count, count(x.doc_id) AS hit_count,
    round(count(x.doc_id) * 100.0 / count(*), 2)::DOUBLE AS hit_percent,
    {len(RULES.keywords)}::BIGINT AS keywords_count
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM h) x ON x.doc_id = d.doc_id""",
)
def checker_stats(spark, sf_dir):
    found = match.with_words(documents(spark, sf_dir, "text"), RULES)
    return report.checker_stats(found, len(RULES.keywords))


@query(
    "match_distinct_text",
    f"""WITH {hits_cte()}, {NESTED_CTE} SELECT d.doc_id, md5(d.text) AS md5,
      n.kind, n.term, n.positions FROM documents d JOIN n ON n.doc_id = d.doc_id""",
)
def match_distinct_text(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    found = match.match_distinct_text(docs, RULES, "doc_id")
    return match.explode_words(found, ["doc_id", "md5"]).select(
        "doc_id", "md5", "kind", "term", F.array_join("positions", ",").alias("positions")
    )


# A dictionary of the size that shipped rule files have, taken from the texts.
MANY = 250


@query(
    "kw_many_terms",
    f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-z]{{4,12}}')) AS word FROM documents),
    k AS (SELECT word FROM w GROUP BY word ORDER BY count(*) DESC, word LIMIT {MANY}),
    p AS (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) AS p FROM k)
    SELECT term, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, p)) AS term FROM documents, p)
    GROUP BY term""",
)
def kw_many_terms(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    words = docs.select(F.explode(F.expr("regexp_extract_all(text, '[a-z]{4,12}', 0)")).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(MANY)
    many = rules_from_dict({"sensitive_patterns": {"many": {"keywords": [r.word for r in top.collect()], "weight": 0.9}}})
    return report.term_totals(match.with_words(docs, many, order="longest"))


# ---------------------------------------------------- declared in configs only
def _rules_values() -> str:
    def val(v):
        return "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(val(v) for v in row) + ")" for row in RULES.rows())


@query(
    "rules_table",
    f"""WITH r AS (SELECT * FROM (VALUES {_rules_values()}) t(kind, category, term, weight, ord)), {hits_cte()},
    t AS (SELECT kind, term, count(*) AS hits FROM h GROUP BY kind, term)
    SELECT r.kind, r.category, r.term, CAST(r.weight AS DOUBLE) AS weight, CAST(r.ord AS BIGINT) AS ord,
      coalesce(t.hits, 0) AS hits FROM r LEFT JOIN t
      ON t.term = r.term AND t.kind = CASE WHEN r.kind = 'mark' THEN 'keyword' ELSE r.kind END""",
)
def rules_table(spark, sf_dir):
    found = match.with_words(documents(spark, sf_dir, "text"), RULES)
    totals = (
        match.explode_words(found, ["doc_id"])
        .groupBy(F.col("kind").alias("hit_kind"), "term")
        .agg(F.sum("n").alias("hits"))
    )
    rules = RULES.table(spark).withColumn(
        "hit_kind", F.when(F.col("kind") == "mark", "keyword").otherwise(F.col("kind"))
    )
    return rules.join(totals, ["hit_kind", "term"], "left").select(
        "kind", "category", "term", "weight", F.col("ord").cast("bigint").alias("ord"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
    )


_CAT_VALUES = ", ".join(
    f"({lit('keyword' if r[0] == 'mark' else r[0])}, {lit(r[1]) if r[1] else 'NULL'}, {lit(r[2])}, {r[3] if r[3] is not None else 'NULL'})"
    for r in RULES.rows()
)


@query(
    "category_hits",
    f"""WITH r AS (SELECT * FROM (VALUES {_CAT_VALUES}) t(kind, category, term, weight)), {hits_cte()}
    SELECT h.doc_id, r.category, h.term, CAST(r.weight AS DOUBLE) AS weight, count(*) AS n
    FROM h JOIN r ON r.kind = h.kind AND r.term = h.term GROUP BY ALL""",
)
def category_hits(spark, sf_dir):
    found = match.with_words(documents(spark, sf_dir, "text"), RULES)
    per_term = match.explode_words(found, ["doc_id"])
    return match.category_hits(per_term, RULES).select(
        "doc_id", "category", "term", "weight", F.col("n").cast("bigint").alias("n")
    )


@query(
    "weighted_score",
    f"""WITH r AS (SELECT * FROM (VALUES {_CAT_VALUES}) t(kind, category, term, weight)), {hits_cte()},
    x AS (SELECT DISTINCT h.doc_id, h.kind, h.term, r.weight FROM h JOIN r ON r.kind = h.kind AND r.term = h.term)
    SELECT doc_id, round(CAST(sum(weight) AS DOUBLE), 4) AS weight_sum, CAST(max(weight) AS DOUBLE) AS weight_max,
      coalesce(max(weight) >= {RULES.threshold}, false) AS over_threshold FROM x GROUP BY doc_id""",
)
def weighted_score(spark, sf_dir):
    found = match.with_words(documents(spark, sf_dir, "text"), RULES)
    tagged = match.category_hits(match.explode_words(found, ["doc_id"]), RULES)
    return match.weighted_score(tagged, ["doc_id"], RULES.threshold).withColumn(
        "weight_sum", F.round("weight_sum", 4)
    )


_RE2 = {name: p.replace(r"\d", "[0-9]") for name, (p, _) in RULES.regexes.items()}


@query(
    "regex_rules",
    " UNION ALL ".join(
        f"SELECT doc_id, {lit(name)} AS term, CAST(pos AS BIGINT) AS pos FROM {spans_sql(p)}"
        for name, p in _RE2.items()
    ),
)
def regex_rules(spark, sf_dir):
    found = match.regex_hits(documents(spark, sf_dir, "text"), RULES, ["doc_id"])
    return found.select("doc_id", "term", F.col("pos").cast("bigint").alias("pos"))


# ------------------------------------------------------- large files and members
@query(
    "block_hits",
    f"WITH {hits_cte()} SELECT kind, term, count(*) AS n FROM h GROUP BY kind, term",
)
def block_hits(spark, sf_dir):
    found = blocks.large_hits(text_files(spark, sf_dir), RULES, size=1 << 20)
    return found.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "member_block_hits",
    f"WITH {hits_cte()} SELECT doc_id, kind, term, CAST(pos AS BIGINT) AS pos FROM h",
)
def member_block_hits(spark, sf_dir):
    found = blocks.member_hits(zip_files(spark, sf_dir), RULES, size=1 << 20)
    doc_id = "cast(regexp_extract(member, '([0-9]+)[.]txt$', 1) AS bigint) AS doc_id"
    return found.selectExpr(doc_id, "kind", "term", "pos")


@query(
    "member_states",
    """SELECT doc_id, state, CASE state WHEN 'text' THEN n_chars END AS n_chars FROM
    (SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, unnest(['text', 'skipped']) AS state
     FROM documents WHERE text <> '')""",
)
def member_states(spark, sf_dir):
    parts = blocks.member_blocks(blocks.member_list(zip_files(spark, sf_dir)), size=1 << 16)
    states = parts.groupBy("member", "status").agg(F.sum("chars").alias("n_chars"))
    doc_id = "cast(regexp_extract(member, '([0-9]+)[.]', 1) AS bigint) AS doc_id"
    return states.selectExpr(doc_id, "status AS state", "n_chars")


# ------------------------------------------------------------ dictionary tables
# Names to look for, as a table: words and pairs of words of the benchmark texts.
TERMS_SQL = """SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,16}')) AS term FROM benchmark
  UNION SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{2,7} [a-z]{2,8}')) FROM benchmark"""
PLACES_SQL = f"""k AS (SELECT term, length(term) AS size FROM ({TERMS_SQL})),
  u AS (SELECT doc_id, unnest(string_split(text, '')) AS c,
    unnest(range(0, length(text))) AS pos FROM documents),
  w AS (SELECT doc_id, pos, {" || ".join(f"coalesce(lead(c, {i}) OVER o, '')" for i in range(16))} AS s
    FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
  z AS (SELECT doc_id, pos, s, unnest(range(5, 17)) AS size FROM w),
  e AS (SELECT doc_id, term, pos, k.size FROM z JOIN k ON left(s, z.size) = term AND length(left(s, z.size)) = k.size)"""
_SUMMARY = "count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos"


def _terms(spark, sf_dir):
    words = "explode(regexp_extract_all(text, '{}', 0)) AS term"
    items = table(spark, sf_dir, "benchmark", "text")
    one = items.selectExpr(words.format("[a-z]{5,16}"))
    return one.unionByName(items.selectExpr(words.format("[a-z]{2,7} [a-z]{2,8}")))


def _summary(hits):
    return hits.groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pos").cast("bigint").alias("first_pos"),
        F.max("pos").cast("bigint").alias("last_pos"),
    )


@query("dictionary_hits", f"WITH {PLACES_SQL} SELECT doc_id, term, {_SUMMARY} FROM e GROUP BY doc_id, term")
def dictionary_hits(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    return _summary(dictionary.dictionary_hits(docs, _terms(spark, sf_dir), ["doc_id"]))


@query(
    "dictionary_longest",
    f"""WITH RECURSIVE {PLACES_SQL},
    b AS (SELECT doc_id, pos, max(size) AS size FROM e GROUP BY doc_id, pos),
    l AS (SELECT doc_id, pos, pos + size AS ends,
      CASE WHEN pos < max(pos + size) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      THEN 0 ELSE 1 END AS opens FROM b),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l),
    s AS (SELECT n.doc_id, n.island, n.pos, n.ends, n.opens, x.pos AS after
      FROM n ASOF LEFT JOIN n x ON n.doc_id = x.doc_id AND n.island = x.island AND n.ends <= x.pos),
    t AS (SELECT doc_id, island, pos, ends, after FROM s WHERE opens = 1
      UNION ALL
      SELECT s.doc_id, s.island, s.pos, s.ends, s.after
      FROM t JOIN s ON t.doc_id = s.doc_id AND t.island = s.island AND t.after = s.pos)
    SELECT doc_id, count(*) AS n, CAST(sum(ends - pos) AS BIGINT) AS covered, CAST(max(pos) AS BIGINT) AS last_pos
    FROM t GROUP BY doc_id""",
)
def dictionary_longest(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    found = dictionary.dictionary_hits(docs, _terms(spark, sf_dir), ["doc_id"])
    return dictionary.without_overlaps(found, ["doc_id"]).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("term")).cast("bigint").alias("covered"),
        F.max("pos").cast("bigint").alias("last_pos"),
    )
