"""Character data of XML against a parser."""

import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from glintscan.functions import text
from glintscan.functions.xml import character_data

PARTS = [
    "<a>", "</a>", "<b k='1 > 0'>", "</b>", "<c/>", "<c d=\"x\" e='y' />", "text", " & ", "&amp;", "&lt;i&gt;", "&#65;", "&nbsp;",
    "<![CDATA[x > y & <z>]]>", "<!-- n > <o> -->", "<?go > ?>", "<", ">", "]]>", "机密", "\n", "</ a>", "<é>", "</é>", "<1>", "<a b>",
]


def parsed(raw: str):
    try:
        return "".join(ElementTree.fromstring(f"<root>{raw}</root>").itertext())
    except ElementTree.ParseError:
        return None


def test_random_content_equals_a_parser(spark):
    draw = random.Random(5)
    rows = ["", "plain", *PARTS]
    for _ in range(3000):
        parts = draw.choices(PARTS[:11] + PARTS[12:15] if draw.random() < 0.7 else PARTS, k=draw.randint(1, 6))
        if draw.random() < 0.5:
            parts = ["<a>", *parts, "</a>"]
        rows.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: r.d for r in df.selectExpr("i", f"{character_data('t')} AS d").collect()}
    well = 0
    for i, raw in enumerate(rows):
        want = parsed(raw)
        well += want is not None
        assert (got[i] is None) == (want is None), raw
        if want is not None:
            assert got[i].replace("&#65;", "A").replace(" ", "") == want.replace(" ", ""), raw
    assert 500 < well < len(rows)


def test_clean_keeps_sections_and_drops_comments_and_attributes(spark):
    rows = [
        "<![CDATA[x > y secret]]>", '<a k="2 > 1" t="no">in</a>', "<a><!-- note > body -->in</a>", "<a>one<b>two</b>three</a>",
        "<p>open <b>tags</p>", None, "", "<a>" * 200 + "deep" + "</a>" * 200, "&#26426;&amp;x", "word " * 50_000 + "<b/>",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = [r.c for r in df.select("i", text.xml_clean("t").alias("c")).orderBy("i").collect()]
    assert got[:9] == ["x y secret", "in", "in", "one two three", "open tags", None, "", "deep", "机 x"]
    assert got[9] == " ".join(["word"] * 50_000)
    assert df.select(F.expr(character_data("t"))).count() == len(rows)
