"""Encodings and OpenDocument files, alone and in whole scans."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glintscan.functions import detect, encoding, opendocument
from glintscan.plans import scan
from glintscan.sources.rules import rules_from_dict

CHINESE = "机密文件:本公司的财务报表不得外传。第12条,员工必须遵守保密协议,否则承担法律责任。\n内部资料 token 不得公开\n" * 3
TAIWAN = "機密文件:本公司的財務報表不得外傳。第12條,員工必須遵守保密協議,否則承擔法律責任。\n內部資料不得公開\n" * 3
ENGLISH = "The token = secret words, line one.\nSecond line: more text.\n" * 3
FRENCH = "Le café naïve de l'été, où le garçon a payé 12 francs à la créperie du château.\n" * 4


def _cases():
    out = []
    for text in (CHINESE, ENGLISH, FRENCH):
        out += [(text.encode("utf-8"), "utf-8", text), (b"\xef\xbb\xbf" + text.encode("utf-8"), "utf-8-sig", text)]
        for name, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
            out += [(mark + text.encode(name), "utf-16", text), (text.encode(name), name, text)]
        for name, mark in (("utf-32-le", b"\xff\xfe\x00\x00"), ("utf-32-be", b"\x00\x00\xfe\xff")):
            out.append((mark + text.encode(name), "utf-32", text))
    out += [(CHINESE.encode("gb18030"), "gb18030", CHINESE), (TAIWAN.encode("big5"), "big5", TAIWAN)]
    out += [(FRENCH.encode("latin-1"), "latin-1", FRENCH), ("短".encode("gbk"), "gb18030", "短")]
    out += [((CHINESE + "𠀀").encode("gb18030"), "gb18030", CHINESE + "𠀀")]
    rnd = random.Random(3)
    out += [(bytes(rnd.randrange(256) for _ in range(3000)), None, None), (bytes(range(256)) * 9, None, None)]
    out += [(b"\x00\x01\x02\x03" * 500, None, None), (b"", "utf-8", ""), (None, None, None)]
    return out


def test_charset_and_text(spark):
    cases = _cases()
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, (b, _, _) in enumerate(cases)], "i int, content binary")
    name = F.expr(encoding.charset("content")).alias("name")
    got = {r.i: r for r in encoding.with_text(df, "content", "d").select("i", name, "d").collect()}
    for i, (raw, want, text) in enumerate(cases):
        if raw is None:
            assert got[i].d.text is None and got[i].d.encoding is None
            continue
        assert got[i].name == want, (i, raw[:20])
        if text is not None:
            assert got[i].d.text == text and got[i].d.encoding == want


def test_scan_finds_words_in_every_encoding(spark):
    rules = rules_from_dict({"security_marks": ["机密", "token"]})
    rows, want = [], {}
    for i, (raw, name, text) in enumerate(_cases()):
        if raw and name and text:
            path = f"/in/{i}.{'log' if i % 2 else 'dat'}"
            rows.append((path, len(raw), bytearray(raw)))
            want[path] = sorted((w, j) for w in ("机密", "token") for j in range(len(text)) if text.startswith(w, j))
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    for r in scan.scan(df, rules).collect():
        assert (r.error, r.skipped) == (None, False), r.file_path
        assert sorted((w.term, p) for w in r.words for p in w.positions) == want[r.file_path], r.file_path


def test_formats_of_other_encodings(spark):
    texts = {"text/csv": "a,b,c\n1,2,3\n", "application/json": '{"a": "é"}', "text/markdown": "## Titel\ntext é\n", "text/plain": "naïve é"}
    rows = [(m, n, bytearray(t.encode(n))) for m, t in texts.items() for n in ("utf-16", "utf-8-sig", "latin-1", "utf-16-le")]
    df = spark.createDataFrame(rows, "mime string, name string, content binary")
    for r in df.select("mime", "name", F.expr(detect.text_mime("''", "content")).alias("got")).collect():
        assert r.got == r.mime, r


def _odf(kind, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", f"application/vnd.oasis.opendocument.{kind}")
        z.writestr("content.xml", f"<office:document-content><office:body>{body}</office:body></office:document-content>")
    return out.getvalue()


ODT = (
    '<office:text><text:h text:style-name="a">Title &amp; more</text:h><text:p/><text:p>one<text:s text:c="3"/>two<text:s/>x<text:tab/>'
    'y<text:line-break/>z</text:p>\n<text:p text:style-name="P1">机密 <text:span>bold</text:span> &#x4E2D;</text:p></office:text>'
)
ODS = (
    '<office:spreadsheet><table:table table:name="S"><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell>'
    '<table:table-cell table:number-columns-repeated="2"/><table:table-cell table:number-columns-repeated="2"><text:p>b</text:p></table:table-cell>'
    '<table:table-cell table:number-columns-repeated="16380"/></table:table-row>'
    '<table:table-row table:number-rows-repeated="2"><table:table-cell><text:p>机密</text:p><text:p>l2</text:p></table:table-cell></table:table-row>'
    '<table:table-row table:number-rows-repeated="1048570"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    "</table:table></office:spreadsheet>"
)


@pytest.mark.parametrize("kind, name, body, text", [
    ("text", "a.odt", ODT, "Title & more\n\none   two x\ty\nz\n\n机密 bold 中"),
    ("presentation", "a.odp", ODT, "Title & more\n\none   two x\ty\nz\n\n机密 bold 中"),
    ("spreadsheet", "a.ods", ODS, "a\t\t\tb\tb\n机密\nl2\n机密\nl2"),
])
def test_opendocument(spark, kind, name, body, text):
    raw = _odf(kind, body)
    df = spark.createDataFrame([(f"/in/{name}", len(raw), bytearray(raw))], "path string, length long, content binary")
    r = scan.scan(df, rules_from_dict({"security_marks": ["机密"]})).first()
    assert r.error is None and r.content == text
    assert r.mime_type.endswith("opendocument." + kind) and [w.term for w in r.words] == ["机密"]


def test_opendocument_without_text(spark):
    row = spark.range(1).selectExpr(opendocument.document_text("''") + " AS a", opendocument.sheet_text("'<x/>'") + " AS b").first()
    assert (row.a, row.b) == ("", "")


def test_bytes_are_decoded_in_portions():
    import pyarrow as pa

    content = pa.array(["é".encode("utf-16-le") * (1 << 20)] * 5 + [None, b"\xef\xbb\xbfa"])
    names = pa.array(["utf-16-le"] * 5 + [None, "utf-8"])
    got = list(encoding._decode_as.func(iter([(content, names)])))
    assert len(got) > 1 and [len(t or "") for a in got for t in a.to_pylist()] == [1 << 20] * 5 + [0, 1]
