"""Archive members, Office Open XML parts and container texts.

Names, kinds, texts, paragraphs, cells, slides, counts and limits are Spark
expressions over inflated members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.functions import fixed, office, opendocument
from glintscan.functions.cols import any_of, case, is_in, let, lit
from glintscan.functions.paths import suffix
from glintscan.functions.unzip import MEMBER_TEXT, TEXT_MEMBERS, TYPE_MEMBERS, boxed, inflated

# --------------------------------------------------------------------- archives
def folder_of(member: str) -> str:
    return f"regexp_extract({member}, '^(.*)/', 1)"


def leaf_of(member: str) -> str:
    return f"substring_index({member}, '/', -1)"


def is_safe(member: str) -> str:
    return f"NOT startswith({member}, '/') AND NOT array_contains(split({member}, '/'), '..')"


def is_junk(member: str) -> str:
    prefixed = any_of(f"startswith({leaf_of(member)}, {lit(p)})" for p in fixed.ARCHIVE_JUNK_PREFIXES)
    return f"({prefixed} OR array_contains(split({folder_of(member)}, '/'), '__MACOSX'))"


def skipped_members(rows: DataFrame, max_members: int | None, max_total: int | None) -> DataFrame:
    """``path, seq`` of the members that the limits leave out.

    Members are taken folder by folder, upper folders first, names sorted. Only
    names and sizes come together, not texts.
    """
    full = any_of(
        ([f"a.n >= {max_members}"] if max_members is not None else [])
        + ([f"a.used + x.size > {max_total}"] if max_total is not None else [])
    )
    step = (
        f"(a, x) -> CASE WHEN {full} THEN struct(a.n AS n, a.used AS used, array_append(a.gone, x.seq) AS gone) "
        "WHEN x.is_text THEN struct(a.n + 1 AS n, a.used + x.size AS used, a.gone AS gone) ELSE a END"
    )
    start = "struct(0 AS n, 0L AS used, cast(array() AS array<int>) AS gone)"
    ranked = rows.where("NOT junk").groupBy("path").agg(
        F.expr("array_sort(collect_list(struct(depth, folder, member, seq, size, is_text)))").alias("all")
    )
    return ranked.select("path", F.explode(F.expr(f"aggregate(all, {start}, {step}).gone")).alias("seq"))


def archive_members(
    files: DataFrame,
    preview_chars: int | None = None,
    max_members: int | None = None,
    max_total: int | None = None,
    max_member: int | None = None,
    max_archive: int | None = None,
) -> DataFrame:
    """One row per archive member; a damaged or oversized archive is one error row.

    ``kind`` is text, binary, skipped or error (damaged and encrypted members,
    with their ``error``). Everything is read whole unless a limit is given:
    characters of a preview, texts and bytes of text of an archive, bytes of a
    member to be read as text, bytes of an archive. Members with unsafe names
    are left out.
    """
    small = files if max_archive is None else files.where(F.col("length") <= max_archive)
    rows = inflated(small, TEXT_MEMBERS).where(f"member IS NULL OR ({is_safe('member')})")
    rows = rows.selectExpr(
        "path",
        "seq",
        "member",
        "length(member) - length(replace(member, '/', '')) AS depth",
        f"{folder_of('member')} AS folder",
        f"{suffix('member')} AS extension",
        "size",
        f"coalesce({is_junk('member')}, false) AS junk",
        f"{MEMBER_TEXT.format('data')} AS text",
        "error",
    )
    short = "true" if max_member is None else f"size < {max_member}"
    known = is_in("extension", fixed.ARCHIVE_TEXT_EXTENSIONS)
    rows = rows.withColumn("is_text", F.expr(f"coalesce({known} AND {short} AND text RLIKE {lit(r'(?U)\S')}, false)"))
    gone = "junk"
    if max_members is not None or max_total is not None:
        left_out = skipped_members(rows.where("member IS NOT NULL"), max_members, max_total)
        rows = rows.join(left_out.withColumn("gone", F.lit(True)), ["path", "seq"], "left")
        gone = "junk OR coalesce(gone, false)"
    kind = case(
        [("member IS NULL", "NULL"), (gone, "'skipped'"), ("error IS NOT NULL", "'error'"), ("is_text", "'text'")],
        "'binary'",
    )
    shown = "text"
    if preview_chars is not None:
        shown = f"if(length(text) > {preview_chars}, concat(left(text, {preview_chars}), '...[内容已截断]'), text)"
    out = rows.withColumn("kind", F.expr(kind)).selectExpr(
        "path", "member", "depth", "extension", "size", "kind",
        f"if(kind = 'text', {shown}, NULL) AS preview",
        "if(kind = 'skipped', NULL, error) AS error",
    )
    if max_archive is None:
        return out
    mb = "format_string('%.2f', length / (1024 * 1024))"
    large = files.where(F.col("length") > max_archive).selectExpr(
        "path", "cast(NULL AS string) AS member", "cast(NULL AS int) AS depth", "cast(NULL AS string) AS extension",
        "cast(NULL AS bigint) AS size", "cast(NULL AS string) AS kind", "cast(NULL AS string) AS preview",
        f"concat('压缩文件过大 (', {mb}, ' MB)，跳过解压，防止解压炸弹') AS error",
    )
    return out.unionByName(large)


def archive_stats(members: DataFrame) -> DataFrame:
    """Per archive: member counts by kind and the deepest folder."""
    return members.where(F.col("member").isNotNull()).groupBy("path").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.max("depth").alias("max_depth"),
        F.count_if(F.col("kind") == "text").alias("text_files"),
        F.count_if(F.col("kind") == "binary").alias("binary_files"),
        F.count_if(F.col("kind") == "skipped").alias("skipped_files"),
    )


def archive_extensions(members: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent member extensions over all archives."""
    return (
        members.where((F.col("extension") != "") & F.col("member").isNotNull())
        .groupBy("extension")
        .agg(F.count(F.lit(1)).alias("files"))
        .orderBy(F.desc("files"), "extension")
        .limit(top)
    )


# ------------------------------------------------------------ Office Open XML
def office_kind(names: str) -> str:
    """docx, xlsx, pptx or NULL by the member names of a file."""
    return case(
        [(f"array_contains({names}, {lit(n)})", f"'{kind}'") for n, kind in (
            ("word/document.xml", "docx"), (office.BOOK, "xlsx"), (office.DECK, "pptx"))]
    )


def part_of(member: str, data: str, sheets: str, strings: str, sheet_rows: int | None) -> str:
    """One member's part: text and counts; NULL for members without text of their own."""
    none = {"rows": "int", "columns": "int", "shapes": "int", "images": "int", "charts": "int", "tables": "int"}

    def row(file_type: str, part: str, name: str, text: str, **counts: str) -> str:
        fields = ", ".join(f"cast({counts.get(n, 'NULL')} AS {t}) AS {n}" for n, t in none.items())
        return f"struct('{file_type}' AS file_type, cast({part} AS int) AS part, {name} AS name, {text} AS text, {fields})"

    xml = f"make_valid_utf8(cast({data} AS string))"
    body = let(
        xml, "xm", let(office.paragraphs("xm"), "ps", row(
            "docx", "1", "'body'", "array_join(ps, '\\n\\n')", rows="size(ps)",
            tables=f"size({office.tags('xm', 'tbl')})")))
    shown = "rs" if sheet_rows is None else f"slice(rs, 1, {sheet_rows})"
    digits = f"try_cast(regexp_extract({member}, {lit(r'(\d+)\.xml$')}, 1) AS int)"
    place = f"array_position(transform({sheets}, s -> concat('xl/', s.target)), {member})"
    sheet = let(
        office.sheet_rows(xml, strings), "rs", let(place, "at", row(
            "xlsx", f"if(at > 0, at, {digits})", f"coalesce(get({sheets}, cast(at AS int) - 1).title, {leaf_of(member)})",
            f"array_join(transform({shown}, r -> r.text), '\\n')", rows="size(rs)",
            columns="coalesce(array_max(transform(rs, r -> r.width)), 0)")))
    shapes = let(
        office.slide_shapes(xml), "ss", row(
            "pptx", digits, f"concat('slide', {digits})",
            "array_join(transform(filter(ss, s -> s.text <> ''), s -> s.text), '\\n')", shapes="size(ss)",
            **{n: f"size(filter(ss, s -> s.kind = '{k}'))" for n, k in (("images", "pic"), ("charts", "chart"), ("tables", "table"))}))
    return case(
        [(f"{member} RLIKE {lit(f'^(?:{pattern})$')}", value) for pattern, value in (
            (office.DOCX_BODY, body), (office.SHEET, sheet), (office.SLIDE, shapes))]
    )


def _data(box: str, name: str) -> str:
    return f"cast(get(filter({box}, m -> m.member = {lit(name)}), 0).data AS string)"


def office_parts(box: str, sheet_rows: int | None = None) -> str:
    """The parts of an Office file in order, from its members; NULL for other files."""
    part = part_of("m.member", "m.data", "sl", "st", sheet_rows)
    found = f"filter(transform(bx, m -> {part}), p -> p IS NOT NULL AND p.file_type = kn)"
    ordered = f"array_sort({found}, (a, b) -> CASE WHEN a.part < b.part THEN -1 WHEN a.part > b.part THEN 1 ELSE 0 END)"
    sheets = office.sheet_places(_data("bx", office.BOOK), _data("bx", office.RELATIONS))
    inner = let(sheets, "sl", let(office.shared_strings(_data("bx", office.SHARED)), "st", ordered))
    kind = office_kind("transform(bx, m -> m.member)")
    return let(box, "bx", let(kind, "kn", f"if(kn IS NULL, NULL, {inner})"))


def all_errors(box: str) -> str:
    """The errors of all members, NULL if there is none."""
    found = f"transform(filter({box}, m -> m.error IS NOT NULL), m -> m.error)"
    return f"nullif(array_join(array_distinct({found}), '; '), '')"


def left_members(box: str) -> str:
    """Names of the members of an archive that are not searched, for their name or place."""
    searched = f"m.member RLIKE {lit(f'^(?:{TEXT_MEMBERS})$')} AND {is_safe('m.member')} AND NOT {is_junk('m.member')}"
    return f"transform(filter({box}, m -> m.member IS NOT NULL AND NOT ({searched})), m -> m.member)"


def ooxml_parts(files: DataFrame, sheet_rows: int | None = None) -> DataFrame:
    """Text of docx, xlsx and pptx files: one row per body, sheet or slide.

    ``rows``/``columns`` describe the whole sheet; ``sheet_rows`` cuts only the
    sheet's text (``None`` keeps it whole). Sheets are in workbook order, found
    by relation id; slides are numbered by their member's name. Unreadable files
    and files with an unreadable part give one error row.
    """
    boxes = files.select("path", boxed("content", office.PARTS).alias("box"))
    made = boxes.selectExpr("path", f"{office_parts('box', sheet_rows)} AS parts", f"{all_errors('box')} AS problem")
    error = "coalesce(problem, if(parts IS NULL, 'not an Office Open XML file', NULL))"
    rows = made.selectExpr("path", f"{error} AS error", f"explode_outer(if({error} IS NULL, parts, NULL)) AS p")
    return rows.selectExpr(
        "path", "p.file_type", "p.part", "p.name", "coalesce(p.text, '') AS text", "p.rows", "p.columns",
        "p.shapes", "p.images", "p.charts", "p.tables", "error",
    )


def slide_stats(parts: DataFrame) -> DataFrame:
    """Deck totals of pptx files."""
    return parts.where(F.col("file_type") == "pptx").groupBy("path").agg(
        F.count(F.lit(1)).alias("slides"),
        F.count_if(F.col("text") != "").alias("slides_with_content"),
        F.sum("shapes").alias("total_shapes"),
        F.sum("images").alias("total_images"),
        F.sum("charts").alias("total_charts"),
        F.sum("tables").alias("total_tables"),
    )


# ------------------------------------------------------------------------ scans
SCAN_MEMBERS = "|".join([office.PARTS, opendocument.BODY, TEXT_MEMBERS, TYPE_MEMBERS])


def archive_text(box: str) -> str:
    """Texts of an archive's text members, in member order."""
    taken = f"filter({box}, m -> {is_safe('m.member')} AND NOT {is_junk('m.member')} AND m.member RLIKE {lit(f'^(?:{TEXT_MEMBERS})$')})"
    body = MEMBER_TEXT.format("m.data")
    return f"array_join(filter(transform({taken}, m -> {body}), t -> t RLIKE {lit(r'(?U)\S')}), '\n\n')"


def office_text(box: str) -> str:
    """Texts of all parts of an Office file."""
    return f"array_join(transform({office_parts(box)}, p -> p.text), '\n\n')"


def odf_text(box: str, mime: str) -> str:
    """Text of an OpenDocument file: paragraphs, or the rows of its sheets."""
    body = f"make_valid_utf8({_data(box, 'content.xml')})"
    sheets = f"{mime} = 'application/vnd.oasis.opendocument.spreadsheet'"
    return let(body, "xm", f"if({sheets}, {opendocument.sheet_text('xm')}, {opendocument.document_text('xm')})")
