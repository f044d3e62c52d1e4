"""Files, archives, sheets and the scan over folders."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelight.operators.rules import Rule
from sievelight.plans.scan import as_scans, scan_files
from sievelight.operators.contextual import default_entities
from sievelight.operators.ignore import mark_ignored
from sievelight.sources.archives import ArchiveLimits, audit_zip_encryption, docx_text, expand_zip, zip_texts
from sievelight.sources.files import (
    is_hidden_path,
    is_in_watched_dirs,
    read_file_inventory,
    read_files,
)
from sievelight.sources.sheets import sheet_cells_to_text


def make_zip(entries, nested=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


def flagged(data, aes=False):
    """Mark the first entry of an archive as encrypted, with an AES field when asked."""
    data = bytearray(data)
    at = data.find(b"PK\x01\x02")
    data[at + 8] |= 1
    if aes:
        name_len = struct.unpack_from("<H", data, at + 28)[0]
        extra = struct.pack("<HHHH", 0x1234, 0, 0x9901, 0)
        data[at + 46 + name_len : at + 46 + name_len] = extra
        struct.pack_into("<H", data, at + 30, len(extra))
        end = data.rfind(b"PK\x05\x06")
        size = struct.unpack_from("<I", data, end + 12)[0]
        struct.pack_into("<I", data, end + 12, size + len(extra))
    return bytes(data)


def files(spark, **content):
    rows = [(k, bytearray(v)) for k, v in content.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def test_audit(spark):
    plain = make_zip([("a.txt", "x"), ("b.txt", "y")])
    df = files(spark, none=plain, weak=flagged(plain), aes=flagged(plain, aes=True), junk=b"nope", cut=plain[:-5], empty=b"")
    got = {r["path"]: r["zip_encryption"] for r in audit_zip_encryption(df).collect()}
    assert got == {"none": "none", "weak": "zipcrypto", "aes": "aes", "junk": "unknown", "cut": "unknown", "empty": "unknown"}


def test_expand_limits(spark):
    deep = make_zip([("d3.txt", "three")])
    for level in ("c.zip", "b.zip", "a.zip"):
        deep = make_zip([(level, deep), (level + ".txt", level)])
    big = make_zip([("1.txt", "a" * 40), ("2.txt", "b" * 70), ("3.txt", "c" * 40), ("4.txt", "d" * 40), ("5.bin", "e")])
    df = files(spark, deep=deep, big=big, junk=b"no archive")
    got = {(r["path"], r["entry"]) for r in zip_texts(expand_zip(df)).collect()}
    # without limits nested archives are opened all the way down
    down = {"a.zip.txt", "a.zip!b.zip.txt", "a.zip!b.zip!c.zip.txt"}
    assert {e for p, e in got if p == "deep"} == down | {"a.zip!b.zip!c.zip!d3.txt"}
    assert {r["entry"] for r in zip_texts(expand_zip(df.filter("path = 'deep'"), limits=ArchiveLimits(depth=2))).collect()} == down
    limited = expand_zip(df.filter("path = 'big'"), limits=ArchiveLimits(total_bytes=160, entry_bytes=60))
    # the large entry is skipped but counted, so the fourth exceeds the total; both leave a mark
    assert [(r["entry"], r["error"]) for r in limited.collect()] == [
        ("1.txt", None), ("2.txt", "limit"), ("3.txt", None), ("4.txt", "limit"), ("5.bin", "limit"),
    ]
    few = expand_zip(df.filter("path = 'big'"), limits=ArchiveLimits(entries=2))
    assert [r["error"] for r in few.collect()] == [None, None, "limit", "limit", "limit"]


def test_damaged_archives_are_rows(spark):
    """A broken stream, a broken nested archive and no archive at all end neither the job nor the archive."""
    good = make_zip([("1.txt", "alpha " * 50), ("2.txt", "beta " * 50), ("in.zip", b"PK\x03\x04 no"), ("3.txt", "gamma")])
    at = good.find(b"2.txt") + len("2.txt")
    broken = good[:at] + bytes(b ^ 0x5A for b in good[at : at + 12]) + good[at + 12 :]
    rows = expand_zip(files(spark, broken=broken, junk=b"no archive", empty=b"")).collect()
    got = {(r["path"], r["entry"], r["error"]) for r in rows}
    assert got == {
        ("broken", "1.txt", None), ("broken", "2.txt", "unreadable"), ("broken", "in.zip", "unreadable"),
        ("broken", "3.txt", None), ("junk", None, "unreadable"), ("empty", None, "unreadable"),
    }


def test_archive_that_holds_itself_ends():
    """An archive is not opened inside itself."""
    from sievelight.sources import archives

    data = make_zip([("a.txt", "x")])
    chain = list(archives._entries(archives._open(data), archives.ArchiveLimits(), 0, "", (), (data,)))
    assert [(e[0], e[5]) for e in chain] == [("a.txt", None)]
    inner = make_zip([("self.zip", data)])
    chain = list(archives._entries(archives._open(inner), archives.ArchiveLimits(), 0, "", (), (data, inner)))
    assert [(e[0], e[5]) for e in chain] == [("self.zip", "cycle")]


def test_docx(spark):
    body = make_zip([("x.xml", "no"), ("word/B.XML", "<b/>"), ("docProps/a.xml", "<a/>"), ("word/c.xml", b"\0")])
    df = files(spark, d=body)
    assert docx_text(df).first()["text"] == "\n<b/>\n<a/>"
    assert docx_text(df, max_bytes=3).first()["text"] == "\n<b"


def test_sheets(spark):
    cells = [("f", 0, "A", 0, 1, "b"), ("f", 0, "A", 0, 0, "a"), ("f", 0, "A", 5000, 0, "far"), ("f", 0, "A", 1, 50, "wide"),
             ("f", 0, "A", 1, 0, ""), ("f", 1, "B", 0, 0, "c"), ("f", 2, "C", 0, 0, None)]
    df = spark.createDataFrame(cells, "path string, sheet_no int, sheet string, row int, col int, value string")
    text = lambda **o: [r["text"] for r in sheet_cells_to_text(df, **o).orderBy("sheet_no").collect()]
    assert text() == ["sheet:A\na\nb\nwide\nfar\n", "sheet:B\nc\n", "sheet:C\n"]
    assert text(max_rows=5000, max_cols=50) == ["sheet:A\na\nb\n", "sheet:B\nc\n", "sheet:C\n"]
    text = lambda **o: [r["text"] for r in sheet_cells_to_text(df, max_rows=5000, max_cols=50, **o).orderBy("sheet_no").collect()]
    assert text(max_bytes=12) == ["sheet:A\na\nb\n"]
    assert text(max_bytes=13) == ["sheet:A\na\nb\n", "sheet:B\n"]
    assert text(max_bytes=11) == ["sheet:A\na\n"]


@pytest.mark.parametrize(
    ("path", "hidden"),
    [("/a/.b/c", True), ("/a/b/.c", True), (".x", True), ("./a/../b", False), ("/a/b.c", False), ("/a/...x", True), ("..", False)],
)
def test_hidden(spark, path, hidden):
    assert spark.createDataFrame([(path,)], "p string").select(is_hidden_path("p")).first()[0] is hidden


def test_watched_dirs(spark):
    df = spark.createDataFrame([("/a/b",), ("/a/bc/d",), ("/a/b/c",)], "p string")
    assert [r[0] for r in df.select(is_in_watched_dirs("p", ["/a/b/"])).collect()] == [True, False, True]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    put = lambda n, b: (root / n).write_bytes(b if isinstance(b, bytes) else b.encode())
    put("plain.txt", "ann@shop.org é")
    put("sub/cookies.json", '{"sid": 1}\nsid=abcdef1')
    put("sub/binary.dat", b"ann@shop.org\0")
    put("sub/unknown.dat", b"bob@shop.org \xff")
    put("notes.ics", "password: 12345678\nghp_abcdefgh1")
    put(".git/x.txt", "ann@shop.org")
    put("half.txt.part", "ann@shop.org")
    put("box.zip", make_zip([("a.txt", "ann@shop.org carl@shop.org"), ("n.zip", make_zip([("b.md", "dora@shop.org")]))]))
    put("weak.zip", flagged(make_zip([("a.txt", "secret"), ("b.txt", "ann@shop.org")])))
    put("doc.docx", make_zip([("word/document.xml", "<w>eve@shop.org signed by John Smith name</w>")]))
    put("large.txt", "ann@shop.org " * 400)
    return root


def test_inventory(spark, folder):
    rows = read_file_inventory(spark, [str(folder), str(folder / "missing")])
    names = {r["path"].rsplit("/", 1)[1] for r in rows.collect()}
    assert ".git" not in str(names) and "half.txt.part" not in names and "binary.dat" in names
    assert rows.count() == 9
    assert read_file_inventory(spark, [str(folder / "missing")]).count() == 0
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_scan_files(spark, folder):
    rules = [Rule("boxes", "low", filename_regex="box"), Rule("gh", "high", value_regex=r"ghp_\w+")]
    values = spark.createDataFrame([("email", "ann@shop.org")], "category string, value string")
    ignored = mark_ignored(None, values, "s", 1)
    reports = scan_files(
        spark, [str(folder)], rules=rules, entities=default_entities(), ignored=ignored, salt="s",
        max_file_bytes=5000,
    )
    got = {r["path"].rsplit("/", 1)[1]: r for r in reports.collect()}
    mails = {n: next((f["count"] for f in r["findings"] if f["category"] == "email"), 0) for n, r in got.items()}
    # archives do not consult the ignore list; binary and large files are not read
    assert mails == {"plain.txt": 0, "cookies.json": 0, "binary.dat": 0, "unknown.dat": 1, "notes.ics": 0,
                     "box.zip": 3, "weak.zip": 1, "doc.docx": 1, "large.txt": 0}
    assert [f["category"] for f in got["cookies.json"]["findings"]] == ["cookie"]
    assert [f["category"] for f in got["notes.ics"]["findings"]] == ["secret"]
    assert [f["category"] for f in got["notes.ics"]["custom_findings"]] == ["gh"]
    assert got["weak.zip"]["weak_zip_encryption"] and got["weak.zip"]["risk_level"] == "medium"
    assert [(f["category"], f["count"]) for f in got["box.zip"]["custom_findings"]] == [("boxes", 1)]
    assert got["large.txt"]["reasons"][0]["key"] == "reason.fileTooLarge"
    stored = as_scans(reports, F.lit(77))
    assert stored.filter("scanned_at = 77").count() == 9


def test_extracted_texts_join_their_files(spark, folder):
    (folder / "paper.pdf").write_bytes(b"%PDF")
    extracted = spark.createDataFrame(
        [(str(folder / "paper.pdf"), [1], "b@shop.org 2"), (str(folder / "paper.pdf"), [0], "aa@shop.org")],
        "path string, part array<int>, text string",
    )
    reports = scan_files(spark, [str(folder)], extracted=extracted)
    row = reports.filter("path like '%paper.pdf'").first()
    assert row["findings"][0]["redacted_examples"] == ["aa***@shop.org", "b***@shop.org"]
    kinds = {r["content_kind"] for r in read_files(spark, [str(folder)]).select("content_kind").collect()}
    assert kinds == {"text", "other", "zip", "docx", "pdf"}


def test_archives_reach_python_in_small_batches(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from sievelight.sources.archives import expand_zip

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    files = spark.range(0, 60, 1, 1).select("id", F.col("id").cast("string").alias("path"), F.expr("cast(repeat('x', 1000000) as binary)").alias("content"))
    assert expand_zip(files).where("error = 'unreadable'").count() == 60

    @F.pandas_udf("long")
    def together(content: pd.Series) -> pd.Series:
        return pd.Series(content.map(len).sum(), index=content.index)

    assert files.agg(F.max(together("content"))).first()[0] <= 6_000_000
    spark.conf.set(key, "1000")
    expand_zip(files)
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)
