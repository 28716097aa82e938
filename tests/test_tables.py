"""Text functions, ordered sums, data-set operators against brute force."""

import html
import random

import pytest
from pyspark.sql import functions as F

from glintscan.functions import text
from glintscan.operators import classify, dataset
from glintscan.operators.ordered import running, with_row_number
from glintscan.sources import delimited, sheets


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").selectExpr(f"{expr} AS r").first().r


def test_running_totals_with_hot_key_and_ties(spark):
    rng = random.Random(1)
    rows = [(i, 5 if rng.random() < 0.5 else rng.randint(0, 9), rng.choice("aaab"), rng.randint(1, 4)) for i in range(800)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, ts int, kind string, v int").repartition(5)
    got = running(df, ["ts", "id"], {"total": "v", "n": "1L"}, {"per_kind": ("kind", "v")}, slices=6)
    want, total, kinds = {}, 0, {}
    for n, (i, _, kind, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += v
        kinds[kind] = kinds.get(kind, 0) + v
        want[i] = (total, n, kinds[kind])
    assert {r.id: (r.total, r.n, r.per_kind) for r in got.collect()} == want
    numbered = with_row_number(df, ["ts", "id"]).collect()
    assert {r.id: r.row_number for r in numbered} == {i: w[1] for i, w in want.items()}


def test_running_totals_array(spark):
    from glintscan.functions.cols import running_totals

    for n in (0, 1, 5, 127, 128, 129, 1000):
        df = spark.sql(f"SELECT slice(sequence(1, {max(n, 1)}), 1, {n}) AS a")
        got = df.selectExpr(f"{running_totals('a', 16)} AS r").first().r
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_cap_rows_keeps_the_first_of_a_hot_group(spark):
    rows = [(g, i) for g, n in (("hot", 3000), ("cold", 3)) for i in range(n)]
    capped = sheets.cap_rows(spark.createDataFrame(rows, "g string, i long").repartition(6), ["g"], ["i"], 100)
    got = {}
    for r in capped.collect():
        got.setdefault(r.g, []).append(r.i)
    assert sorted(got["hot"]) == list(range(100)) and sorted(got["cold"]) == [0, 1, 2]


def test_sheets(spark):
    df = spark.range(50).selectExpr("id", "id * 2 AS b", "id * 3 AS c")
    want = list(range(4, 10))
    assert [r.id for r in sheets.pick_rows(df, "5:10", ["id"]).collect()] == want
    assert sorted(r.id for r in sheets.pick_rows(df, "5:10", ["id"], small=1).collect()) == want
    assert sheets.pick_columns(df, "B:C").columns == ["b", "c"] == sheets.pick_columns(df, "2:3").columns
    assert sheets.column_index("AB") == 27
    merged = sheets.merge_sheets({"x": df.select("id"), "y": df.select("b")})
    assert merged.columns == ["id", "sheet_name", "b"] and merged.count() == 100


def test_dedup(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id long, md5 string")
    assert sorted(r.id for r in dataset.keep_first(df).collect()) == [1, 2]
    assert [r.id for r in dataset.drop_all_repeats(df).collect()] == [2]
    assert [(r.md5, r.copies) for r in dataset.duplicate_groups(df).collect()] == [("x", 2)]
    sides = spark.range(5000).select(dataset.split_side(F.col("id")).alias("s")).groupBy("s").count()
    share = {r.s: r["count"] for r in sides.collect()}["train"] / 5000
    assert 0.67 < share < 0.73


@pytest.mark.parametrize(
    "value", ["a &amp;lt; b", "&lt;p&gt; &#65; &eacute; &copy", "x & y", "&amp;copy;", "&quot;&apos;", None]
)
def test_html_unescape(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    want = None if value is None else html.unescape(value)
    assert df.select(text.html_unescape("t").alias("r")).first().r == want


def test_cleaning(spark):
    assert one(spark, "Hello, 世界! x1", text.token_clean("t")) == "hello 世界 x1"
    assert one(spark, "Hello, 世界! x1", text.token_clean("t", digits=False)) == "hello 世界 x"
    assert one(spark, "a /* b\nc */ URL(x) var(--y) d", text.css_clean("t")) == "a d"
    assert one(spark, " a　\tb ", text.collapse("t")) == "a b"
    assert one(spark, "abc" * 100, text.preview("t", 5)) == "abcab..."
    df = spark.createDataFrame([("<p>A &amp; b</p>", "text/xml"), ("/*x*/ c", "text/css"), ("", "x")], "t string, f string")
    got = [r[0] for r in df.select(text.clean_dispatch("t", "f")).collect()]
    assert got == ["a b", "c", ""]


def test_paragraph_budget(spark):
    paras = ["a" * 30, "b" * 50, "c" * 50, "d" * 20]
    joined = "\n\n".join(paras + ["short", "%$#@!" * 10])
    kept = text.paragraphs("t")
    assert one(spark, joined, kept) == paras
    assert one(spark, joined, text.budget_paragraphs(kept, 1000)) == paras
    assert one(spark, joined, text.budget_paragraphs(kept, 110)) == [paras[1], paras[2]]


def test_words(spark):
    words = " ".join(str(i) for i in range(1000))
    want = [" ".join(str(i) for i in range(s, min(s + 512, 1000))) for s in range(0, 1000, 256)]
    assert one(spark, words, text.word_chunks("t")) == want
    assert one(spark, "  ", text.word_chunks("t")) == []
    synonyms = {"1": "one", "7": "seven"}
    want = " ".join(synonyms.get(w, w) for w in words.split())
    assert one(spark, words, text.replace_synonyms("t", synonyms)) == want
    kept = one(spark, words, text.delete_words("t", "1")).split()
    assert 700 < len(kept) < 900 and one(spark, "only", text.delete_words("t", "1")) == "only"


def test_delimiters(spark, tmp_path):
    assert one(spark, "a;b;c;d;e;f", text.sniff_delimiter("t")) == ";"
    assert one(spark, "a;b", text.sniff_delimiter("t")) == ","
    (tmp_path / "t.csv").write_text("a|b|c|d\n1|1.5|x|\n2|2|y|3\n")
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"))
    got = {r.column_name: r.column_type for r in delimited.column_profile(df).collect()}
    assert got == {"a": "int64", "b": "float64", "c": "object", "d": "float64"}


def test_classifier_learns_and_reports(spark):
    rows = [(i, ("secret plan " if i % 2 else "public note ") + f"w{i % 5}", float(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, label double")
    model, history = classify.train_classifier(df.where("id < 60"), df.where("id >= 60"), (0.1, 0.01), buckets=256)
    assert len(history) == 2
    scored = classify.predict(model, df)
    assert scored.where("prediction != label").count() == 0
    top = classify.predict_max_chunk(model, df, "id", threshold=0.5)
    assert top.count() == 80
    report = {r["class"]: r.f1 for r in classify.class_report(scored.withColumn("label", F.col("label").cast("int"))).collect()}
    assert report["accuracy"] == 1.0 and report["macro avg"] == 1.0
    best = classify.top_features(df.where("label = 1"), ["secret", "s", "plan"], ["w[0-9]"], 10).collect()
    assert [(r.feature, r.weight) for r in best] == [("plan", 40), ("secret", 40), ("w[0-9]", 40)]
