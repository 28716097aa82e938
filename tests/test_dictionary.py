"""Dictionaries as tables against the keyword pattern and against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from glintscan.operators import match
from glintscan.operators.dictionary import dictionary_hits, without_overlaps
from glintscan.sources.rules import rules_from_dict

TABLES = "/root/testdata/sf0.001"


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def terms(spark, words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def everywhere(rows, words):
    found = set()
    for i, text in enumerate(rows):
        for word in {w for w in words if w}:
            at = (text or "").find(word)
            while at >= 0:
                found.add((i, word, at))
                at = text.find(word, at + 1)
    return found


def got(df):
    rows = [(r.id, r.term, r.pos) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_edges_and_long_terms(spark):
    long = "".join(random.Random(1).choice("ab机") for _ in range(200))
    words = ["a", "ab", "机", "机密", "abc", "aaaa", "𐍈x", "x", long, long[:50], "a" * 120, None, "", "ab", "."]
    rows = ["", None, "𐍈x abc 机密", f"x{long}{long} {long[:-1]}", "a" * 300, "ab" * 40, ".\n.", "no"]
    rows += [("x" * 4090 + "ab机密" + "y" * 5000) * 70 + "机"]
    want = everywhere(rows, words)
    assert got(dictionary_hits(texts(spark, rows), terms(spark, words), ["id"])) == want
    parted = dictionary_hits(texts(spark, rows), terms(spark, words), ["id"], part_terms=4, piece=16)
    assert got(parted) == want


def test_empty_tables(spark):
    assert got(dictionary_hits(texts(spark, ["a b"]), terms(spark, ["x"]).limit(0), ["id"])) == set()
    assert got(dictionary_hits(texts(spark, ["a"]).limit(0), terms(spark, ["a"]), ["id"])) == set()


def test_equals_the_pattern_of_250_keywords(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    seen = docs.select(F.explode(F.split("text", " ")).alias("term")).where("length(term) BETWEEN 2 AND 9")
    words = [r.term for r in seen.groupBy("term").count().orderBy("count", "term").limit(220).collect()]
    words += [r.term for r in seen.groupBy("term").count().orderBy(F.desc("count"), "term").limit(30).collect()]
    rules = rules_from_dict({"security_marks": words})
    found = dictionary_hits(docs, terms(spark, words), ["id"])
    want = {(r.id, r.term, r.pos) for r in match.overlapping_hits(docs, rules, ["id"]).collect()}
    assert len(want) > 1000
    assert got(found) == want
    longest = match.hits(docs, rules, ["id"], order="longest", kinds=("keyword",))
    assert got(without_overlaps(found, ["id"])) == {(r.id, r.term, r.pos) for r in longest.collect()}


@pytest.mark.parametrize("count", [200_000])
def test_very_many_keywords(spark, count):
    words = spark.range(count).selectExpr("substring(md5(cast(id AS string)), 1, 6 + cast(id % 12 AS int)) AS term")
    planted = [f"see {r.term}, {r.term}" for r in words.limit(count).where("rand(3) < 0.001").collect()]
    rows = planted + ["nothing here"] * 50
    found = got(dictionary_hits(texts(spark, rows), words, ["id"]))
    here = {t for text in planted for t in [text.split(" ")[2]]}
    assert everywhere(rows, here) <= found
    assert all(rows[i][pos : pos + len(term)] == term for i, term, pos in found)


def test_lookup_finds_every_row_of_a_piece_in_bounded_arrays():
    import numpy as np
    import pyarrow as pa

    from glintscan.operators import dictionary

    pieces = ["aa", "aa", "a", "b\U0001f600c", "xyz"]
    part = pa.table({"piece": pieces, "term": ["aa", "aab", "a", "b\U0001f600c", "xyz"]})
    lookup = dictionary._Lookup(part, 3)
    lookup.most = 3
    text = "aaa b\U0001f600c xy"
    found = list(lookup.find(dictionary._codes([text]).astype(np.uint64)))
    assert all(len(places) <= 3 for places, _ in found)
    hits = sorted((int(p), int(r)) for places, rows in found for p, r in zip(places, rows))
    assert hits == sorted((i, r) for r, w in enumerate(pieces) for i in range(len(text)) if text.startswith(w, i))


def test_texts_over_a_chunk(spark):
    from glintscan.operators import dictionary

    rows = ["ab" * dictionary.CHUNK + "needle" + "\U0001f600" * 9 + "needle", None, ""]
    rows.append("x" * (dictionary.CHUNK - 3) + "needle" + "y" * dictionary.CHUNK)
    words = ["needle", "y" * 60 + "z", "e\U0001f600", "xxneed"]
    assert got(dictionary_hits(texts(spark, rows), terms(spark, words), ["id"])) == everywhere(rows, words)
