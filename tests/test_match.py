"""Matching against Python's re on hand cases and random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glintscan.functions.match import keyword_pattern
from glintscan.operators import match
from glintscan.sources.rules import load_rules, rules_from_dict

RULES = rules_from_dict(
    {
        "security_marks": ["机密", "aa"],
        "sensitive_patterns": {
            "c": {"keywords": ["现金流量", "现金流量表", "a.b", "ab", "aab", "aa", "😀b"], "weight": 0.9}
        },
        "structured_patterns": {r"密码[\s：:]*\w{6,20}": 0.9, "(": 1, "x*": 1},
        "number_patterns": [r"\d{3}"],
    }
)


def texts():
    rng = random.Random(7)
    hand = [
        "现金流量表", "aaaa", "机密😀机密", "a.b axb", "密码:abc123中文", "", "   ", None,
        "a\u0001a aab﷐ 机密  aab123", "\u0001﷐aab 机密123aa", "aab" * 700,
    ]
    alphabet = "ab.机密现金流量表1😀 \n"
    return hand + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(300)]


def expected(text, order, cap):
    if not text or not text.strip():
        return []
    words = RULES.keywords if order == "config" else sorted(RULES.keywords, key=len, reverse=True)
    found = {}
    for m in re.finditer("|".join(map(re.escape, words)), text):
        found.setdefault(m.group(), []).append(m.start())
    out = [(k, v[:cap]) for k, v in found.items()]
    for p in [*RULES.structured, *RULES.numbers]:
        at = [m.start() for m in re.finditer(p, text)]
        if at:
            out.append((p, at[:cap]))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id long, text string").repartition(4)


@pytest.mark.parametrize("order,cap", [("config", None), ("longest", 10)])
def test_checked_equals_re(table, order, cap):
    got = {
        r.id: [(w.term, list(w.positions)) for w in r.words]
        for r in match.with_words(table, RULES, order=order, cap=cap).collect()
    }
    for i, text in enumerate(texts()):
        assert got[i] == expected(text, order, cap), text


def test_overlapping_equals_find(table):
    want = set()
    for i, text in enumerate(texts()):
        for o, word in enumerate(RULES.keywords):
            at = (text or "").find(word)
            while at != -1:
                want.add((i, o, word, at))
                at = text.find(word, at + 1)
    rows = match.overlapping_hits(table, RULES, ["id"]).collect()
    got = [(r.id, r.ord, r.term, r.pos) for r in rows]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_patterns():
    assert re.findall(keyword_pattern(["ab", "abc", "b"]), "abcb") == ["ab", "b"]
    assert re.findall(keyword_pattern(["ab", "abc", "b"], "longest"), "abcb") == ["abc", "b"]
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choices("ab.", k=rng.randint(1, 4))) for _ in range(8)]
        text = "".join(rng.choices("ab.", k=40))
        for order, flat in (("config", words), ("longest", sorted(words, key=len, reverse=True))):
            want = [m.span() for m in re.finditer("|".join(map(re.escape, flat)), text)]
            got = [m.span() for m in re.finditer(keyword_pattern(words, order), text)]
            assert got == want


def test_rules_are_validated(spark, tmp_path):
    assert [r[1] for r in RULES.rejected] == ["(", "x*"]
    path = tmp_path / "rules.yaml"
    path.write_text(
        "threshold: 0.5\nsecurity_marks: [机密]\nsensitive_patterns:\n  人事:\n    keywords: [简历]\n"
        "    weight: 0.9\nnumber_patterns: ['[']\n",
        encoding="utf-8",
    )
    for rules in (load_rules(str(path)), load_rules(str(path), spark)):
        assert rules.keywords == ["机密", "简历"]
        assert rules.threshold == 0.5 and len(rules.rejected) == 1
    rows = rules.table(spark).collect()
    assert [(r.kind, r.category, r.term) for r in rows] == [("mark", None, "机密"), ("keyword", "人事", "简历")]


def test_chunks_cover_long_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "id long, text string")
    rows = match.char_chunks(df, ["id"], threshold=100, width=50, step=40).collect()
    got = sorted((r.start, r.chunk) for r in rows if r.id == 1)
    assert got == [(i, text[i : i + 50]) for i in range(0, 5000, 40)]
    assert [(r.start, r.chunk) for r in rows if r.id == 2] == [(0, "short")]
    capped = match.char_chunks(df, ["id"], threshold=100, width=50, step=40, max_chunks=10)
    assert capped.where("id = 1").count() == 10


def test_chunked_positions_are_absolute(spark):
    df = spark.createDataFrame([(1, "x" * 95 + "机密" + "y" * 100)], "id long, text string")
    size = {"threshold": 50, "width": 60, "step": 40}
    found = match.chunked_hits(df, RULES, ["id"], **size)
    assert [(r.term, r.pos) for r in found.collect()] == [("机密", 95)]
    relative = match.chunked_hits(df, RULES, ["id"], absolute=False, **size)
    assert {r.pos for r in relative.collect()} == {15, 55}
    many = spark.createDataFrame([(1, "机密xx" * 100), (2, None), (3, "")], "id long, text string")
    for cap in (None, 3):
        words = match.chunked_words(many, RULES, ["id"], cap=cap, **size).where("term = '机密'").collect()
        assert [(r.id, r.positions) for r in words] == [(1, list(range(0, 400, 4))[:cap])]


def test_repeated_text_is_matched_once_and_given_to_all(spark):
    rows = [(i, "机密 same") for i in range(400)] + [(1000 + i, f"ab {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string")
    want = {(r.id, str(r.words)) for r in match.with_words(df, RULES).collect()}
    for limits in ({}, {"hot_copies": 20}, {"hot_copies": 20, "broadcast_ids": 0}):
        got = match.match_distinct_text(df, RULES, "id", salts=7, **limits).collect()
        assert len(got) == len(rows)
        assert {(r.id, str(r.words)) for r in got} == want


def test_gate(spark, table):
    said = spark.createDataFrame([(0, 1), (1, 0), (5, 1)], "id long, prediction int")
    gated = match.gated_check(table, RULES, said, "id")
    words = {r.id: [w.term for w in r.words] for r in gated.where("id < 10").collect()}
    assert words[0] == ["现金流量"] and words[1] == [] and len(words[5]) == 1 and words[2] == []


def test_matching_does_not_shuffle(table):
    plan = match.hits(table.sparkSession.range(10).select("id", F.lit("aa").alias("text")), RULES, ["id"])
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
