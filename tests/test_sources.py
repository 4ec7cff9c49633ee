from __future__ import annotations

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lettermill.sources import lines, mbox, mime
from lettermill.sources.rtf import rtf_to_text


def test_mbox(spark, tmp_path):
    box = b"From a\nSubject: x\n  y\nTo: b@c.test\n\nbody\nFrom b\nSubject: z\nFrom c\n\nend\n"
    assert [m[:6] for m in mbox.split_mbox(box)] == [b"From a", b"From b"]
    assert mbox.split_mbox(b"lead\nFrom a\n\nx\n")[0] == b"lead\n" and mbox.split_mbox(b"") == []
    assert len(mbox.split_mbox(box, drop_last=True)) == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mbox").write_bytes(box)
    found = mbox.read_mbox(spark, str(tmp_path / "in"))
    assert b"".join(r.raw for r in found.orderBy("msg_no").collect()) == box
    heads = {(r.msg_no, r.name): r.value for r in mbox.header_lines(found).collect()}
    assert heads[1, "Subject"] == "x  y" and heads[1, "To"] == "b@c.test"
    mbox.write_mbox(found, str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.mbox"))) == box
    mbox.register(spark)
    found.createOrReplaceTempView("boxes")
    assert spark.sql("SELECT count(*) FROM boxes, LATERAL split_mbox(raw)").first()[0] == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"ok \xff line\n:directive \n")
    rows = lines.read_lines(spark, str(tmp_path / "t.txt"))
    assert [r.line for r in rows.collect()] == ["ok  line", ":directive "]
    out = rows.select(lines.pass_directives(F.col("line"), F.split(F.lower("line"), " "))).collect()
    assert out[1][0] == ":directive"
    df = spark.createDataFrame([(5, ["a", "b"]), (100, ["c"])], "s int, t array<string>")
    lines.append_score_log(df, "s", "t", str(tmp_path / "log"))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "log").glob("*.gz"))
    assert sorted(raw.decode().splitlines()) == ["  5%:a b", "100%:c"]
    assert {(r.score, tuple(r.tokens)) for r in lines.read_score_log(spark, str(tmp_path / "log")).collect()} == {(5, ("a", "b")), (100, ("c",))}
    (tmp_path / "map").write_text("ő\to\nbad\n", encoding="utf-8")
    assert lines.read_confusables(spark, str(tmp_path / "map")) == {"ő": "o"}
    lines.route(df.withColumn("verdict", F.lit("ham-1")), "verdict", str(tmp_path / "routed"))
    assert (tmp_path / "routed/verdict=ham-1").is_dir()


@pytest.mark.parametrize(
    ("rtf", "text"),
    [
        (r"{\rtf1\ansi hello\par world}", "hello\nworld"),
        (r"{\rtf1{\fonttbl{\f0 Arial;}}x}", "x"),
        (r"{\rtf1{\*\unknown hidden}y}", "y"),
        (r"{\rtf1\ansicpg1250 \'f5\'fb!}", "őű!"),
        (r"{\rtf1\uc1\u337?z}", "őz"),
        (r"{\rtf1 a\'e9", "a"),
        (r"{\rtf1 \{b\}}", "{b}"),
        (r"{\rtf1 a{\listtext x}{\shpinst y}{\mmodsofilter z}b\rquote c}", "ab’c"),
        (r'{\rtf1 see {\field{\*\fldinst{HYPERLINK "http://x.test/a"}}{\fldrslt{here}}}.}', 'see here("http://x.test/a").'),
        (r"{\rtf1\uc2\u337??{\uc0\u369}\u225\'61?z}", "őűáz"),
        (r"{\rtf1 a}b{\b c}}lost", "abc"),
        ("plain text, no RTF", "plain text, no RTF"),
        ("{" * 5000 + "deep", "deep"),
        ("", ""),
    ],
)
def test_rtf(rtf, text):
    assert rtf_to_text(rtf) == text


def _docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_docx_and_mixed():
    assert mime.docx_to_text(_docx("<w:p><w:t>a</w:t><w:br/><w:tab ><w:t xml:space='x'>b</w:t></w:p>")) == "\ta\tb"
    assert mime.decode_mixed("é".encode() + b"\xf5", "utf-8") == "éő" and mime.decode_mixed(b"\xc3\xa9", "none-such") == "é"


def test_candidates(spark):
    long = b"x" * 60
    rows = [
        (1, 0, "text/plain", "utf-8", None, None, b"plain"),
        (1, 1, "text/html", None, None, None, b"<body><p>html"),
        (1, 2, "text/plain", "", None, None, "ő".encode("iso8859-2")),
        (2, 0, "text/plain", "utf-8", None, "attachment", b"gone"),
        (2, 1, "application/octet-stream", None, "A.RTF", "attachment", rb"{\rtf1 " + long + b"}"),
        (2, 2, "application/rtf", None, None, None, b"{broken"),
        (3, 0, "text/plain", "utf-8", None, None, b"y" * 300),
        (3, 1, "application/rtf", None, None, None, rb"{\rtf1 " + long + b"}"),
        (4, 0, "text/plain", "utf-8", None, None, b"bad &#12ab; entity"),
        (5, 0, "text/calendar", "utf-8", None, None, None),
    ]
    df = spark.createDataFrame([*rows, rows[0]], mime.PART)
    got = {(r.msg_no, r.cand_no): r.text for r in mime.candidates(df).collect()}
    assert got == {(1, 1): "\nhtml", (1, 2): "ő", (2, 1): "x" * 60, (3, 1): "y" * 300}


def test_parts_of_a_message(spark):
    raw = b"From: a@b.test\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain; charset=latin2\n\nhi\n--q\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=x.pdf\n\nzz\n--q--\n"
    rows = mime.read_parts(spark.createDataFrame([(1, raw), (2, None)], "msg_no long, raw binary")).collect()
    assert [(r.part_no, r.ctype, r.charset, r.fname, r.disp) for r in rows] == [(1, "text/plain", "latin2", "None", None), (2, "application/pdf", "utf-8", "x.pdf", "attachment")]


def test_charsets(spark):
    names = [None, "", "cp-850", "UTF8-x", "windows-874", "koi8-r"]
    got = spark.createDataFrame([(n,) for n in names], "c string").select(mime.repaired_charset(F.col("c"))).collect()
    assert [r[0] for r in got] == ["utf-8", "iso8859-2", "cp850", "utf-8", "cp874", "koi8-r"]


def test_verdict_mailboxes(spark, tmp_path):
    df = spark.createDataFrame([(1, b"From a\n\nx\n", "ham-1"), (2, b"From b\n\ny\n", "spam/99"), (3, b"From c\n\nz\n", "ham-1"), (4, b"From d\n", None)], "msg_no long, raw binary, verdict string")
    for _ in range(2):  # boxes grow
        mbox.write_mailboxes(df, "verdict", str(tmp_path / "boxes"))
    box = lambda name: sorted(m for p in (tmp_path / "boxes" / name).glob("*.mbox") for m in mbox.split_mbox(p.read_bytes()))
    assert box("test_ham-1") == [b"From a\n\nx\n"] * 2 + [b"From c\n\nz\n"] * 2
    assert box("test_spam_99") == [b"From b\n\ny\n"] * 2 and box("test_none") == [b"From d\n"] * 2
    assert not list(tmp_path.glob("boxes/**/_*"))


def test_zstd_score_log(spark, tmp_path):
    df = spark.createDataFrame([(5, ["a", "b"]), (100, ["c"]), (7, [])], "s int, t array<string>")
    for _ in range(2):
        lines.append_score_log(df, "s", "t", str(tmp_path / "log"), "zstd")
    rows = lines.read_score_log(spark, str(tmp_path / "log"), "zstd").collect()
    assert sorted((r.score, r.tokens) for r in rows) == sorted([(5, ["a", "b"]), (100, ["c"]), (7, [""])] * 2)


def test_own_confusables(spark, tmp_path):
    from lettermill.functions import text

    (tmp_path / "map").write_text("ő\to\nß\tsz\nа\ta\n", encoding="utf-8")
    table = lines.read_confusables(spark, str(tmp_path / "map"))
    df = spark.createDataFrame([("fő straße, pаypal é",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(text.fold(F.col("t"), table)).collect()] == ["fo strasze, paypal ", "plain", None]
    assert df.select(text.tokenize(F.col("t"), table)).first()[0] == ["fo", "strasze", "paypal"]


def test_zeros_before_numbers(spark):
    from lettermill.functions import text

    df = spark.createDataFrame([("&#0000000000233; &#x00000000E9; &#039; &#00;",), ("&#99999999999999999999;",), ("&#12ab;",)], "t string")
    assert [r[0] for r in df.select(text.decode_numeric(F.col("t"))).collect()] == ["é é &#039; &#00;", None, None]
