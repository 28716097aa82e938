"""The Python steps of scans against the SQL forms of the same texts and words."""

import io
import random
import time
import zipfile

from pyspark.sql import functions as F

from glintscan.functions import match, search
from glintscan.functions.inside import IS_ZIP, opened_files
from glintscan.functions.unzip import LARGEST, _opened_member, boxed, inflate
from glintscan.plans import scan
from glintscan.queries import derived
from glintscan.sources.archives import SCAN_MEMBERS, archive_text, office_text
from glintscan.sources.rules import rules_from_dict

PIECES = {
    "word/document.xml": [
        "<w:p>", "</w:p>", "<w:p/>", '<w:p a="1"/>', "<p>", "</p>", "<w:r><w:t>", "</w:t></w:r>", "<t>", "</t>", '<w:t xml:space="preserve">',
        "<w:t/>", "<w:tbl>", "<w:tc>", "a", "机", " ", "\n", "&amp;lt;", "&#65;", "&#x673A;", "&#xD800;", "&#9999", "&", ">", "<", "é",
    ],
    "xl/worksheets/sheet1.xml": [
        "<row>", '<row r="2">', "</row>", "<row/>", "<x:row>", "</x:row>", '<c r="B1" s="2"/>', '<c r="AA7" t="s"><v>1</v></c>', '<c t="s"><v> 0 </v></c>',
        '<c t="s"><v>-1</v></c>', '<c t="s"><v>x</v></c>', '<c t="inlineStr"><is><t>a&amp;b</t></is></c>', '<c t="inlineStr"><is><t>c</t></is></c>',
        '<c r="D9"><v>4.5</v></c>', "<c><v>&lt;</v></c>", "<c>", "</c>", '<c t="b"><v>1</v></c>', "<t>q</t>", "<v>9</v>", "\n", "<x:c t='inlineStr'><x:t>p</x:t></x:c>",
        '<c t="str"><f>A1</f><v>f</v></c>', '<cols><col min="1"/></cols>', "<c", "</is>",
    ],
    "ppt/slides/slide2.xml": [
        "<p:sp>", "</p:sp>", "<p:sp/>", "<p:pic/>", "<p:pic>", "</p:pic>", "<a:tbl>", "</a:tbl>", "<a:tr>", "</a:tr>", "<a:tc>", "</a:tc>", "<c:chart/>",
        "<a:p>", "</a:p>", "<a:t>", "</a:t>", "<a:t> x\u2028</a:t>", "<a:t>y </a:t>", "<a:t>\n</a:t>", "</p:graphicFrame>", "<p:cxnSp/>", "</verylongone:sp>", "z", " ", "\u0085",
    ],
}
# Whole parts, so that most of the odd ones stand among sound ones.
WHOLE = {
    "word/document.xml": ["<w:p><w:r><w:t>a b</w:t></w:r></w:p>", "<w:p><w:t>&#x673A;&amp;</w:t><w:br/><w:t>c</w:t></w:p>"],
    "xl/worksheets/sheet1.xml": [
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row>', '<row><c t="inlineStr"><is><t>x &lt; y</t></is></c></row>',
        '<row r="3" a="<"><c t="s"><v>2</v></c> <c r="E3" s="1"/></row>', "</sheetData><sheetData>",
    ],
    "ppt/slides/slide2.xml": [
        "<p:sp><a:p><a:t> t </a:t></a:p><a:p><a:t>u\u2028</a:t></a:p></p:sp>", "<p:sp><a:p><a:t>p \x85</a:t></a:p></p:sp>",
        "<p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:t>l </a:t></a:p></a:tc><a:tc/></a:tr></a:tbl></p:graphicFrame>",
    ],
}
REST = {
    "word/document.xml": {"word/document.xml": b"<w:p><w:t>late</w:t></w:p>"},
    "xl/worksheets/sheet1.xml": {
        "xl/workbook.xml": b'<sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/><sheet name="c" r:id="r9"/></sheets>',
        "xl/_rels/workbook.xml.rels": b'<Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/other.xml"/>',
        "xl/sharedStrings.xml": b"<si><t>one</t></si><si/><si><r><t>t</t></r><r><t>wo</t></r></si>",
        "xl/worksheets/other.xml": b"<row><c><v>first</v></c></row>",
        "xl/worksheets/sheet3.xml": b"<row><c t='s'><v>0</v></c></row>\xff",
        "xl/worksheets/none.xml": b"<row><c><v>no place</v></c></row>",
    },
    "ppt/slides/slide2.xml": {
        "ppt/presentation.xml": b"",
        "ppt/slides/slide10.xml": b"<p:sp><a:p><a:t>ten</a:t></a:p></p:sp>",
        "ppt/slides/slide1.xml": b"<p:sp><a:tr><a:tc><a:t>l</a:t></a:tc><a:tc/></a:tr></a:tbl></p:sp>",
    },
}
NAMES = [
    "a.txt", "x/../b.txt", "/c.md", "__MACOSX/d.txt", "__MACOSXe.txt", "f/._g.txt", "h.PNG", "i.Txt", "k/l.c", "m\u2028.txt", "n.txſ", "o.txt\n",
    "p\n/__MACOSX/q.txt", "r", "..", "s..txt", "机/t.csv", "content.xml", "mimetype",
]
BYTES = [b"", b" \n", "机密 license".encode(), b"\xff\xfeab", b"\x1c\x1f", "\xa0\u3000".encode(), b"caf\xe9 \xe6\x9c", b"\xef\xbf\xbdx"]


def packed(members: dict | list) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members.items() if isinstance(members, dict) else members:
            archive.writestr(name, data)
    return out.getvalue()


def odd_files(n: int, seed: int = 7) -> list[bytes]:
    draw = random.Random(seed)
    out = []
    for name, pieces in PIECES.items():
        for _ in range(n):
            share = draw.choice([0.5, 5])
            weights = [1] * len(pieces) + [share * len(pieces)] * len(WHOLE[name])
            text = "".join(draw.choices(pieces + WHOLE[name], weights, k=draw.choice([0, 3, 30, 200])))
            out.append(packed({name: text, **REST[name]} if name not in REST[name] else {name: text}))
    for _ in range(n):
        out.append(packed([(name, draw.choice(BYTES)) for name in draw.sample(NAMES, 7)]))
    out.append(packed([("word/document.xml", b"<w:p><w:t>a</w:t></w:p>"), ("word/document.xml", REST["word/document.xml"]["word/document.xml"])]))
    broken = bytearray(out[0])
    broken[45] ^= 0xFF  # in the packed bytes of the first member
    return [*out, bytes(broken), out[1][:-30], b"PK\x03\x04"]


def test_texts_of_zip_files_as_sql_gives_them(spark):
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(odd_files(40))], "i int, content binary").repartition(4)
    df = df.withColumn("old", boxed("content", SCAN_MEMBERS)).withColumn("new", opened_files("content", f"'{IS_ZIP}'", SCAN_MEMBERS))
    rows = df.selectExpr(
        "i", f"{office_text('old')} AS office", f"{archive_text('old')} AS archive", "new.text AS text",
        "transform(old, m -> struct(m.member, m.size, m.error)) AS was", "transform(new.box, m -> struct(m.member, m.size, m.error)) AS now",
        "exists(old, m -> m.member IN ('word/document.xml', 'xl/workbook.xml', 'ppt/presentation.xml')) AS is_office",
    ).collect()
    for row in rows:
        assert row.text == (row.office if row.is_office else row.archive), row.i
        assert row.was == row.now
    assert len({row.text for row in rows}) > 100


def test_members_as_zipfile_reads_them():
    draw = random.Random(3)
    for raw in odd_files(15, seed=4):
        for _ in range(4):
            hurt = bytearray(raw)
            for _ in range(draw.choice([0, 1, 3])):
                hurt[draw.randrange(len(hurt))] = draw.randrange(256)
            hurt, largest = bytes(hurt), draw.choice([20, LARGEST])
            try:
                archive = zipfile.ZipFile(io.BytesIO(hurt))
            except Exception:
                assert [m[0] for m in inflate(hurt, ".*", largest)] == [None]
                continue
            infos = [i for i in archive.infolist() if not i.is_dir()]
            assert [m[2:] for m in inflate(hurt, "(?s:.*)", largest)] == [_opened_member(archive, i, largest) for i in infos]


def test_built_archives_as_zipfile_writes_them(monkeypatch):
    now = time.localtime()
    monkeypatch.setattr(time, "localtime", lambda *a: now)
    for entries in ([], [("a.txt", "")], [(f"l/{i}.txt", "机 x " * i * i) for i in range(120)]):
        assert derived._zip(entries) == derived._zip_any(entries)


def test_words_as_sql_gives_them(spark):
    rules = rules_from_dict(
        {
            "security_marks": ["the", "then", "th", "机密", "a.b", "ande", "deer", " \t"],
            "sensitive_patterns": {"x": {"keywords": ["and", "der", "the", "x😀"], "weight": 1}},
            "structured_patterns": {p: 1 for p in ("[a-z.]+@[a-z]+", r"(?i)the\b", "(?:ab?)+c", r"\d{3}", "a|an", "[^a]b", "机.?密")},
            "number_patterns": ["[0-9]{3,}", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", "(1|12)(3|)"],
        }
    )
    assert [search.is_common(p) for p in rules.structured] == [True, False, True, False, True, True, False]
    draw = random.Random(5)
    parts = ["the", "then", "th", "ander", "deer", "机密", "机x密", "😀", "x", "a.b", "a@b.c@d", "abc", "ab", "12.3.4.5", "123", "٣٣٣", " ", "\t", "\n", "\x01", "\ufdd0", "\x1c", "TH"]
    texts = [None, "", " \t\n", "\x1c \t", *("".join(draw.choices(parts, k=draw.choice([1, 4, 40]))) for _ in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    for options in ({}, {"order": "longest", "cap": 2, "labelled": True}, {"kinds": ("number",)}, {"kinds": ("keyword",), "cap": 1}):
        both = search.with_checked(df.withColumn("old", F.expr(match.checked("text", rules, **options))), "text", "new", rules, **options)
        rows = both.collect()
        assert [r.new for r in rows] == [r.old for r in rows]
        assert any(r.new for r in rows)
    many = rules_from_dict({"security_marks": [chr(0x4E00 + i) + c for i in range(90) for c in "ab"] + ["一"]})
    both = search.with_checked(spark.createDataFrame([("一a 一x 丁b丁c 七",)], "text string"), "text", "new", many)
    assert [(w.term, w.positions) for w in both.first().new] == [("一a", [0]), ("一", [3]), ("丁b", [6])]


def test_long_runs_are_searched_in_time(spark):
    # A rule with a run before its mark took time with the square of such texts.
    rows = [("/a.txt", 400_001, b"x" * 400_000 + b"\n"), ("/b.txt", 13, b"mail a@b.c at")]
    df = spark.createDataFrame(rows, "path string, length bigint, content binary")
    start = time.monotonic()
    found = {r.file_path: [w.term for w in r.words] for r in scan.scan(df, derived.RULES).collect()}
    assert found == {"/a.txt": [], "/b.txt": ["[A-Za-z0-9.]+@[a-z0-9.]+"]}
    assert time.monotonic() - start < 40


def test_scans_take_two_steps_in_python(spark):
    df = spark.createDataFrame([("/a.txt", 3, b"the")], "path string, length bigint, content binary")
    for columns in (["words"], ["file_path", "content", "words", "metadata"], ["error"]):
        plan = scan.scan(df, derived.RULES, order="longest", cap=10).select(*columns)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("ArrowEvalPython") <= 2
        assert len(plan.collect()) == 1
