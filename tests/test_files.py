"""Inventories, type detection and containers on hand-made files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from glintscan.functions import detect, fixed, paths, unzip
from glintscan.operators import filters, match
from glintscan.plans import scan, sinks
from glintscan.queries import derived
from glintscan.queries.derived import RULES
from glintscan.sources import archives, files
from glintscan.streaming import scans

OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in entries.items():
            archive.writestr(name, data)
    return out.getvalue()


def frame(spark, rows):
    data = [(p, len(c), bytearray(c)) for p, c in rows]
    return spark.createDataFrame(data, "path string, length long, content binary")


def test_scan_keeps_what_it_should(spark, tmp_path):
    names = ["a.txt", ".h", "~$c.doc", "[5]Sum", "_u.txt", "empty.txt", "p.jpg", "sub/b.md", "sub/.hid/z.txt"]
    for name in names:
        target = tmp_path / "in" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("" if name == "empty.txt" else "text")
    got = files.scan_files(spark, str(tmp_path / "in"), with_left_out=True)
    rows = {r.path.rpartition("/in/")[2]: (r.length, bytes(r.content)) for r in got.collect()}
    assert set(rows) == {"a.txt", "_u.txt", "empty.txt", "sub/b.md"}
    assert rows["_u.txt"] == (4, b"text") and rows["empty.txt"] == (0, b"")
    routed = scan.routed_files(scan.typed_files(got)).where("is_empty").collect()
    assert [r.mime_type for r in routed] == [fixed.OCTET]


CASES = [
    ("/a.bin", b"%PDF-1.4", "application/pdf"),
    ("/a", b"\xff\xd8\xff\xe0", "image/jpeg"),
    ("/a", b"RIFF\x00\x00\x00\x00WAVEfmt ", "audio/wav"),
    ("/a", b"\x00\x00\x00\x20ftypM4A ", "video/mp4"),
    ("/a.doc", OLE + b"\xff" * 20, fixed.DOC),
    ("/a", OLE + b"Microsoft Excel", fixed.XLS),
    ("/a", OLE + b"\xff" * 20, fixed.OLE),
    ("/a", b"Rar!\x1a\x07", "application/x-rar"),
    ("/a", b"\x1f\x8b\x08", "application/gzip"),
    ("/a", b"", fixed.OCTET),
    ("/a.txt", "密码".encode("gbk"), "text/plain"),
    ("/a", b"\xfe\xff\xfe", fixed.OCTET),
    ("/a.txt", b'{"a": 1}', "application/json"),
    ("/a.txt", b"a,b,c\n1,2,3\n", "text/csv"),
    ("/a.csv", b"abc", "text/plain"),
    ("/a.txt", b"k: v\nz", "application/yaml"),
    ("/a", zipped({"word/document.xml": "x"}), fixed.DOCX),
    ("/a", zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": "x"}),
     "application/vnd.oasis.opendocument.text"),
    ("/a", zipped({"x.txt": "x"}), fixed.ZIP),
]


def test_mime_cascade(spark):
    df = frame(spark, [(f"/d{i}{p}", c) for i, (p, c, _) in enumerate(CASES)])
    got = {r.path: r.mime_type for r in scan.typed_files(df).collect()}
    for i, (p, _, want) in enumerate(CASES):
        assert got[f"/d{i}{p}"] == want, (i, p)


def test_report_labels(spark):
    rows = [
        ("/a.zip", zipped({"AndroidManifest.xml": "x"})), ("/b.class", bytes.fromhex("CAFEBABE00")),
        ("/c.riff", b"RIFF\x00\x00\x00\x00AVI LIST"), ("/d.txt", b"hello"), ("/e.zzz", b"hello"),
        ("/f", "中文".encode()), ("/g", "中文".encode("gbk")), ("/h", b""),
        ("/i.bin", OLE + bytes(600) + "WordDoc".encode("utf-16-le") + b"Bookmark" + bytes(5000)),
        ("/j", b"%PDF-1.4"),
    ]
    got = {r.file_path: r.type for r in scan.type_labels(frame(spark, rows)).collect()}
    assert got["/a.zip"] == "Android应用程序包 (.apk)"
    assert got["/b.class"] == "Java类文件/Mach-O Fat文件"
    assert got["/c.riff"] == "AVI视频 (.avi)"
    assert got["/d.txt"] == "文本文件 (基于文件扩展名)"
    assert got["/e.zzz"] == "未知文件类型 (扩展名: .zzz) (基于文件扩展名)"
    assert got["/f"] == "可能是UTF-8文本文件" and got["/g"] == "可能是GBK文本文件"
    assert got["/h"] == "空文件" and got["/i.bin"] == "Microsoft Word文档 (.doc)"
    assert got["/j"] == "PDF文档"


def test_repeated_signatures_keep_place_and_take_last_label():
    table = detect.signature_table()
    assert len({p for _, p, _ in table}) == len(table)
    assert table[0] == (0, "504B0304", "ZIP压缩包")


def test_legacy_encodings_are_decoded(spark):
    rows = [("/a", "密码机密".encode("gbk")), ("/b", "é 机".encode()), ("/c", b"\xff\x00")]
    got = {r.path: r.text for r in files.read_text(frame(spark, rows)).collect()}
    assert got == {"/a": "密码机密", "/b": "é 机", "/c": "\xff\x00"}
    cut = files.read_text(frame(spark, [("/a", b"abcdef")]), 3).first().text
    assert cut == "abc" + fixed.NOTICE_FILE_CUT


def test_binary_text(spark):
    rows = [
        ("/b", b"\x00\x01\x02" * 50),
        ("/c", b"\n\n".join([b"plain words " * 12, b"short", b"%$#@^&*~" * 10])), ("/d", b"tiny"),
    ]
    got = {r.path: r for r in files.binary_text(frame(spark, rows)).collect()}
    assert got["/c"].text == ("plain words " * 12).strip() and got["/c"].encoding == "utf-8"
    assert got["/b"].error and got["/d"].error and got["/d"].text == ""


def test_encrypted(spark):
    rows = [
        ("/a", OLE + b"EncryptionInfo"), ("/b", b"PK\x03\x04broken"), ("/c", zipped({"EncryptedPackage": "x"})),
        ("/d", zipped({"a": "x"})), ("/e", b"plain"), ("/f", bytes.fromhex("8CBAD9FF0ADA")),
    ]
    df = detect.with_zip_info(frame(spark, rows))
    got = {r.path: r.e for r in df.selectExpr("path", f"{detect.is_encrypted('content', 'zip')} AS e").collect()}
    assert got == {"/a": True, "/b": True, "/c": True, "/d": False, "/e": False, "/f": True}


def test_archive_limits(spark):
    raw = zipped({"../up.txt": "x", "a.txt": "y" * 1500, "b.png": "z", "d/c.txt": "w", "__MACOSX/._a.txt": "m", "e.txt": " "})
    df = frame(spark, [("/z.zip", raw), ("/bad.zip", b"PK\x03\x04")])
    rows = archives.archive_members(df, preview_chars=1000).collect()
    kinds = {r.member: r.kind for r in rows if r.path == "/z.zip"}
    assert kinds == {"a.txt": "text", "b.png": "binary", "e.txt": "binary", "d/c.txt": "text", "__MACOSX/._a.txt": "skipped"}
    preview = next(r.preview for r in rows if r.member == "a.txt")
    assert preview == "y" * 1000 + "...[内容已截断]"
    assert next(r.error for r in rows if r.path == "/bad.zip")
    read = archives.archive_members(df).collect()
    assert next(r.preview for r in read if r.member == "a.txt") == "y" * 1500
    whole = archives.archive_members(df, max_members=1).collect()
    assert {r.member: r.kind for r in whole if r.member}["d/c.txt"] == "skipped"
    big = archives.archive_members(df, max_archive=1).collect()
    assert all(r.error.startswith("压缩文件过大") for r in big)


def test_scan_reads_containers_whole(spark):
    tail = "x" * 3000 + " token"
    doc = zipped({"word/document.xml": f'<d xmlns:w="u"><w:body><w:p><w:t>{tail}</w:t></w:p></w:body></d>'})
    rows = [("/a.zip", zipped({"n.txt": tail})), ("/b.docx", doc), ("/c.pdf", b"%PDF"), ("/d.txt", tail.encode()), ("/e.jpg", b"x")]
    out = {r.file_path: r for r in scan.scan(frame(spark, rows), RULES).collect()}
    for path in ("/a.zip", "/b.docx", "/d.txt"):
        assert [(w.term, list(w.positions)) for w in out[path].words] == [("token", [3001])], path
    assert out["/c.pdf"].error and not out["/c.pdf"].words
    assert out["/e.jpg"].skipped and out["/e.jpg"].error is None


def test_scan_metadata_and_warnings(spark):
    rows = [
        ("/a.csv", b"p;q;r\n1;2;3\n4;5;6\n"), ("/b.md", "# h\n[x](y)\n".encode()), ("/c.txt", "机密 token".encode("gb18030")),
        ("/e.doc", b"plain words"), ("/f.txt", b""),
    ]
    got = {r.file_path: r for r in scan.scan(frame(spark, rows), RULES).collect()}
    meta = {p: r.metadata for p, r in got.items()}
    assert (meta["/a.csv"]["delimiter"], meta["/a.csv"]["rows"], meta["/a.csv"]["columns"]) == (";", "2", "3")
    assert (meta["/b.md"]["headers"], meta["/b.md"]["links"]) == ("1", "1")
    assert meta["/c.txt"]["encoding"] == "gb18030" and got["/c.txt"].content == "机密 token"
    assert got["/e.doc"].mime_mismatch and got["/e.doc"].header_warning == "文件头不符合 .doc 格式"
    # Without commas the bytes say plain text.
    assert got["/a.csv"].mime_mismatch and got["/a.csv"].header_warning is None
    assert not got["/c.txt"].mime_mismatch and got["/c.txt"].header_warning is None
    assert not got["/f.txt"].mime_mismatch and len(got) == len(rows)


def test_files_with_zero_bytes_take_the_most_readable_decoding(spark):
    df = frame(spark, [("/d.txt", "the token 机密".encode("utf-16")), ("/e.txt", b"the token")])
    got = {r.file_path: r for r in scan.scan(df, RULES).collect()}
    assert got["/d.txt"].metadata["encoding"] == "utf-16" and got["/d.txt"].content == "the token 机密"
    assert {w.term for w in got["/d.txt"].words} == {w.term for w in got["/e.txt"].words}


def test_damaged_and_encrypted_members_are_errors(spark):
    raw = zipped({"a.txt": "the token", "b.txt": "unread"})
    broken = bytearray(raw)
    broken[raw.index(b"unread")] ^= 0xFF
    locked = bytearray(zipped({"c.txt": "secret"}))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    df = frame(spark, [("/x.zip", bytes(broken)), ("/y.zip", bytes(locked)), ("/z.zip", b"PK\x03\x04")])
    kinds = {(r.path, r.member): (r.kind, bool(r.error)) for r in archives.archive_members(df).collect()}
    assert kinds == {
        ("/x.zip", "a.txt"): ("text", False), ("/x.zip", "b.txt"): ("error", True),
        ("/y.zip", "c.txt"): ("error", True), ("/z.zip", None): (None, True),
    }
    got = {r.file_path: r for r in scan.scan(df, RULES).collect()}
    assert all(r.error for r in got.values())
    assert "token" in [w.term for w in got["/x.zip"].words]


def test_office_parts(spark):
    doc = zipped({"word/document.xml": "<w:document><w:body><w:p><w:r><w:t>a &amp; b&#x4e2d;</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:pPr/>"
                  '<w:r><w:t xml:space="preserve">cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    book = zipped({
        "xl/workbook.xml": '<workbook><sheets><sheet name="last" r:id="r2"/><sheet name="A &lt; B" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/><Relationship Target="worksheets/sheet3.xml" Id="r2"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>x</t></si><si><r><t>y</t></r><r><t>z</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="B1" t="s"><v>1</v></c><c r="C1" s="4"/><c r="D1"><v>7</v></c></row><row r="2"/></sheetData></worksheet>',
        "xl/worksheets/sheet3.xml": "<worksheet><sheetData><row><c><v>1</v></c><c t='inlineStr'><is><t>in</t></is></c></row></sheetData></worksheet>",
    })
    deck = zipped({
        "ppt/presentation.xml": "<p:presentation/>",
        "ppt/slides/slide1.xml": "<p:sld><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t> one</a:t></a:r></a:p><a:p><a:r><a:t>two</a:t></a:r></a:p></p:txBody></p:sp><p:pic/>"
        "<p:graphicFrame><a:tbl><a:tr><a:tc><a:t>l</a:t></a:tc><a:tc><a:t>r</a:t></a:tc></a:tr></a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>",
    })
    df = frame(spark, [("/a.docx", doc), ("/b.xlsx", book), ("/c.pptx", deck), ("/d.docx", zipped({"x": "y"})), ("/e.docx", b"no")])
    got = {(r.path, r.part): r for r in archives.ooxml_parts(df).collect()}
    assert got["/a.docx", 1].text == "a & b中\n\n\n\ncell" and (got["/a.docx", 1].rows, got["/a.docx", 1].tables) == (3, 1)
    last, first = got["/b.xlsx", 1], got["/b.xlsx", 2]
    assert (last.name, last.text, last.columns) == ("last", "1\tin", 2)
    assert (first.name, first.text, first.rows, first.columns) == ("A < B", "\tyz\t\t7\n", 2, 4)
    slide = got["/c.pptx", 1]
    assert slide.text == "one\ntwo\nl | r" and (slide.shapes, slide.images, slide.tables) == (3, 1, 1)
    assert got["/d.docx", None].error and got["/e.docx", None].error


def test_csv_quotes_are_doubled(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', "x\ny")], "p string, q string")
    sinks.write_csv(df, str(tmp_path / "q"))
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "q"))
    assert back.collect() == df.collect()


def test_report_sinks(spark, tmp_path):
    rows = [("/a.txt", b"the token"), ("/b.txt", b"none"), ("/c.pdf", b"%PDF")]
    results = scan.scan(frame(spark, rows), RULES).withColumn("processing_time", F.lit(0.5))
    sinks.write_report(results, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/summary")).first().sensitive_files == 1
    assert spark.read.parquet(str(tmp_path / "r/detail")).count() == 2
    sinks.write_json_report(results, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/results")).count() == 3
    for form in ("csv", "txt", "json"):
        sinks.export_sheet(results.select("file_path"), str(tmp_path / form), form)
    with pytest.raises(ValueError):
        sinks.export_sheet(results, str(tmp_path / "x"), "xlsx")
    sinks.write_free_keys(results.selectExpr("1 AS extra", "error", "file_path"), str(tmp_path / "k"))
    assert spark.read.option("header", True).csv(str(tmp_path / "k")).columns == ["file_path", "error", "extra"]


def test_samples_append_only_new_hashes(spark, tmp_path):
    rows = [("/1.txt", b"alpha"), ("/2.txt", b"alpha"), ("/3.txt", b"beta"), ("/4.pdf", b"%PDF")]
    df = frame(spark, rows).withColumn("modificationTime", F.timestamp_seconds(F.lit(0)))
    table = str(tmp_path / "samples")
    scan.write_samples(spark, df, 1, table)
    more = frame(spark, [("/5.txt", b"alpha"), ("/6.txt", b"gamma")])
    scan.write_samples(spark, more.withColumn("modificationTime", F.timestamp_seconds(F.lit(0))), 0, table)
    got = {(r.filename, r.is_sensitive) for r in spark.read.parquet(table).collect()}
    assert got == {("1.txt", 1), ("3.txt", 1), ("6.txt", 0)}
    assert scan.load_samples(spark, table).columns == ["content", "is_sensitive"]


def test_file_stream_equals_batch_and_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log, state = str(tmp_path / "log"), str(tmp_path / "state")

    def run():
        stream = scans.stream_files(spark, str(folder), files_per_batch=1)
        found = scans.scan_stream(stream.selectExpr("path", "cast(content AS string) AS text"), RULES)
        scans.run_to_end(lambda: scans.append_log(found.select("path", "words"), log, state))

    (folder / "a.txt").write_text("the token")
    (folder / "b.txt").write_text("nothing")
    run()
    (folder / "c.txt").write_text("token")
    run()
    rows = spark.read.parquet(log).collect()
    assert sorted((r.path[-5:], len(r.words)) for r in rows) == [("a.txt", 2), ("b.txt", 0), ("c.txt", 1)]


def test_block_stream_equals_whole_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("é the token\n" * 3000 + "der Text " * 900)
    (folder / "b.txt").write_text("nothing")
    stream = scans.stream_files(spark, str(folder)).select("path", "length")
    found = scans.scan_block_stream(stream, RULES, size=4096, overlap=64, encoding="utf-8")
    log = str(tmp_path / "log")
    scans.run_to_end(lambda: scans.append_log(found, log, str(tmp_path / "state")))
    rows = spark.read.parquet(log).orderBy("path", "block").collect()
    assert max(r.chars for r in rows) < 3 * 4096 and sum(r.path.endswith("b.txt") for r in rows) == 1
    got, at = [], 0
    for r in (r for r in rows if r.path.endswith("a.txt")):
        got += [(w.term, at + p) for w in r.words for p in w.positions]
        at += r.chars
    whole = files.read_binary(spark, str(folder)).selectExpr("path", "cast(content AS string) AS text")
    want = match.hits(whole, RULES, ["path"]).collect()
    assert sorted(got) == sorted((r.term, r.pos) for r in want) and len(want) > 6000


def test_members_leave_in_portions():
    import pyarrow as pa

    raw = zipped({"a.txt": b"x" * (3 << 20), "b.bin": b"y"})
    got = list(unzip.boxes(iter([pa.array([raw, None, raw, raw, raw, raw, b"PK"])]), r".*[.]txt", 4 << 20))
    assert len(got) == 2 and all(a.nbytes < unzip.PORTION + (4 << 20) for a in got)
    boxes = [b for a in got for b in a.to_pylist()]
    assert [None if b is None else len(b) for b in boxes] == [2, None, 2, 2, 2, 2, 1]
    assert [m["member"] for m in boxes[0]] == ["a.txt", "b.bin"] and len(boxes[0][0]["data"]) == 3 << 20
    assert boxes[0][1]["data"] is None and boxes[-1][0]["error"]


def test_documents_are_packed_in_portions(spark, tmp_path):
    # Chance letters do not deflate: two documents of 5 MB are over a portion.
    letters = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.md5(F.concat(i, F.col("doc_id")))))
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.repeat(letters, 4).alias("text"))
    packed = derived._packed(docs.coalesce(1), lambda d, t: (f"/{d}", t.encode()))
    sizes = packed.mapInArrow(lambda bs: (b.select(["length"]) for b in bs), "length bigint")
    assert {r.length for r in sizes.collect()} == {5_120_000} and packed.count() == 4


def test_large_files_are_matched_unless_gated(spark):
    mb = 1024 * 1024
    box = zipped({"a.txt": b"secret words"})
    rows = [("/in/a.log", 201 * mb, bytearray(b"secret words")), ("/in/b.zip", 150 * mb, bytearray(box))]
    rows += [("/in/_c.log", 7, None)]
    df = spark.createDataFrame(rows, "path string, length long, content binary")
    whole = {r.file_path[4:]: (r.error, "secret" in r.content) for r in scan.scan(df, RULES).collect()}
    assert whole["a.log"] == whole["b.zip"] == (None, True)
    assert whole["_c.log"][0] and not whole["_c.log"][1]
    gated = {r.file_path[4:]: (r.error, r.content) for r in scan.scan(df, RULES, gate=filters.size_gate).collect()}
    assert all(error and not text for error, text in gated.values())


def test_left_out_bytes_over_a_limit_are_null(spark, tmp_path):
    (tmp_path / "_a.txt").write_text("text")
    (tmp_path / "e.txt").write_text("")
    for limit, want in ((None, b"text"), (3, None)):
        got = {r.path[-6:]: r.content for r in files.left_out_files(spark, str(tmp_path), limit=limit).collect()}
        kept = {n.strip("/"): c if c is None else bytes(c) for n, c in got.items()}
        assert kept == {"_a.txt": want, "e.txt": b""}


def test_size_gate_and_names(spark):
    mb = 1024 * 1024
    df = spark.createDataFrame([(10 * mb,), (60 * mb,), (150 * mb,), (201 * mb,)], "n long")
    gates = df.selectExpr(f"{filters.size_gate('n', 'true')} AS a", f"{filters.size_gate('n', 'false')} AS b").collect()
    assert [(g.a, g.b) for g in gates] == [("ok", "ok"), ("warn", "warn"), ("error", "warn"), ("error", "error")]
    names = spark.createDataFrame([("/a/B.TXT",), ("/a/.rc",), ("/a/x.",), ("/a/n",), ("/a/t.tar.gz",)], "p string")
    got = [r[0] for r in names.selectExpr(paths.suffix("p")).collect()]
    assert got == [".txt", "", "", "", ".gz"]
