"""Files and archive members read as blocks give the hits of the whole text."""

import io
import random
import zipfile

import pytest

from glintscan.operators import match
from glintscan.plans import scan
from glintscan.sources import blocks, files
from glintscan.sources.rules import rules_from_dict

RULES = rules_from_dict(
    {
        "security_marks": ["secret", "机密", "机密文件"],
        "sensitive_patterns": {"a": {"keywords": ["token", "é"], "weight": 0.9}},
        "structured_patterns": {r"[a-z]+@[a-z]+\.com": 0.9},
        "number_patterns": ["[0-9]{6}"],
    }
)
WORDS = ["secret", "机密文件", "机密", "token", "é", "me@x.com", "123456", "word", "文", "x", "𐍈"]


def text_of(seed: int, n: int, gaps: str, words=WORDS) -> str:
    draw = random.Random(seed)
    return "".join(draw.choice(words) + draw.choice(gaps) for _ in range(n))


def whole_hits(spark, texts: dict[str, str]) -> set:
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    return {(r.name, r.kind, r.term, r.pos) for r in match.hits(df, RULES, ["name"]).collect()}


def leaf(path: str) -> str:
    return path.rsplit("/", 1)[1]


@pytest.mark.parametrize("size", [64, 256, 1 << 20])
def test_file_blocks_give_the_hits_of_the_whole_text(spark, tmp_path, size):
    gbk = [w for w in WORDS if w not in ("é", "𐍈")] + ["中文内容"]
    texts = {
        "lines.log": (text_of(1, 400, " \n"), "utf-8"),
        "noline.log": (text_of(2, 400, " ,"), "utf-8"),
        "mark.txt": (text_of(3, 300, " \n"), "utf-8-sig"),
        "wide.txt": (text_of(4, 300, " \n"), "utf-16"),
        "gbk.txt": (text_of(5, 300, " \n", gbk), "gb18030"),
        "short.txt": ("secret", "utf-8"),
        "empty.txt": ("", "utf-8"),
    }
    for name, (text, coding) in texts.items():
        (tmp_path / name).write_bytes(text.encode(coding))
    listing = files.list_folder(spark, str(tmp_path)).select("path", "length")
    found = blocks.large_hits(listing, RULES, size=size, overlap=64).collect()
    got = [(leaf(r.path), r.kind, r.term, r.pos) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == whole_hits(spark, {n: t for n, (t, _) in texts.items()})


def test_many_blocks_hold_every_character_once(spark, tmp_path):
    text = text_of(7, 2000, " \n")
    (tmp_path / "a.log").write_text(text, encoding="utf-8")
    made = blocks.file_blocks(files.list_folder(spark, str(tmp_path)), size=128, overlap=32).collect()
    made.sort(key=lambda r: r.block)
    assert len(made) > 50
    assert "".join(r.text[r.lead : r.lead + r.chars] for r in made) == text


def test_members_are_read_in_blocks_and_none_drops_silently(spark, tmp_path):
    def zipped(entries) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
            for name, data in entries.items():
                box.writestr(name, data)
        return out.getvalue()

    long, wide = text_of(8, 1500, " \n"), text_of(9, 300, " \n")
    inner = zipped({"in.txt": wide.encode("utf-16"), "x.dat": b"token"})
    (tmp_path / "a.zip").write_bytes(
        zipped({"long.txt": long, "dir/inner.zip": inner, "b.docx": b"x", "e.txt": "", "bad.zip": b"PK"})
    )
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    listing = files.list_folder(spark, str(tmp_path))
    found = blocks.member_hits(listing, RULES, size=256, overlap=64).collect()
    got = [(r.member, r.kind, r.term, r.pos) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == whole_hits(spark, {"long.txt": long, "dir/inner.zip!/in.txt": wide})
    parts = blocks.member_blocks(blocks.member_list(listing), size=256, overlap=64)
    states = {(r.member, r.status) for r in parts.select("member", "status").distinct().collect()}
    assert states == {
        ("long.txt", "text"), ("dir/inner.zip!/in.txt", "text"), ("dir/inner.zip!/x.dat", "skipped"),
        ("b.docx", "skipped"), ("bad.zip", "error"), (None, "error"),
    }


def test_archives_deeper_than_asked_are_errors(spark, tmp_path):
    data = b"token"
    name = "t.txt"
    for _ in range(4):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as box:
            box.writestr(name, data)
        data, name = out.getvalue(), "box.zip"
    (tmp_path / "a.zip").write_bytes(data)
    listing = files.list_folder(spark, str(tmp_path))
    deep = blocks.member_list(listing, depth=4).collect()
    assert [(r.member, r.error) for r in deep] == [("box.zip!/box.zip!/box.zip!/t.txt", None)]
    flat = blocks.member_list(listing, depth=1).collect()
    assert [r.member for r in flat] == ["box.zip!/box.zip"] and flat[0].error


def test_files_over_a_cell_do_not_end_the_scan(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("secret")
    (tmp_path / "b.log").write_text("secret and a long text")
    monkeypatch.setattr(files, "CELL", 10)
    rows = {leaf(r.file_path): r for r in scan.scan(files.scan_files(spark, str(tmp_path)), RULES).collect()}
    assert rows["a.log"].words and rows["a.log"].error is None
    assert rows["b.log"].error and not rows["b.log"].words
    large = files.read_binary(spark, str(tmp_path)).where("content IS NULL")
    assert [(r.term, r.pos) for r in blocks.large_hits(large, RULES).collect()] == [("secret", 0)]


def test_scan_names_all_errors_and_members_passed_over(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name in ("a.txt", "b.txt", "c.docx", "d.dat", "e.txt"):
            box.writestr(name, "secret")
    raw = bytearray(out.getvalue())
    for name in (b"a.txt", b"b.txt"):  # data that do not fit their check sums
        raw[raw.index(name) + len(name)] ^= 1
    df = spark.createDataFrame([("/in/a.zip", len(raw), raw)], "path string, length long, content binary")
    row = scan.scan(df, RULES).first()
    assert "a.txt" in row.error and "b.txt" in row.error
    assert [w.term for w in row.words] == ["secret"]
    assert row.metadata["skipped_members"] == "c.docx, d.dat"


def test_zips_of_documents_have_bounded_directories(spark, tmp_path, monkeypatch):
    from glintscan.queries import derived
    from glintscan.sources import blocks

    monkeypatch.setattr(derived, "ZIP_DOCUMENTS", 3)
    rows = [(i, None if i == 4 else f"text {i}") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    listed = blocks.member_list(derived.zip_files(spark, str(tmp_path))).collect()
    by_zip = {path: sum(r.path == path for r in listed) for path in {r.path for r in listed}}
    assert max(by_zip.values()) <= 6 and len(listed) == 20
    assert sorted(r.member for r in listed if r.member.endswith(".txt")) == sorted(f"docs/{i}.txt" for i in range(10))
