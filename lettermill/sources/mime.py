"""MIME messages: parts, their charsets and text, attachments, and the text candidates of a message."""

from __future__ import annotations

import email
import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import cut_head, html_to_text, is_html
from ..functions.text import decode_numeric
from ..operators.addresses import decoded
from ..storage import cut
from .rtf import rtf_to_text

#: Names of charsets that codecs do not know. Fixed values.
CHARSETS = {"cp-850": "cp850", "_iso-2022-jp$esc": "iso-2022-jp", "iso-8859-8-i": "iso-8859-8", "windows-874": "cp874", "x-mac-ce": "mac_latin2"}
PART = "msg_no long, part_no int, ctype string, charset string, fname string, disp string, payload binary"
#: Inline text from which attachments are no longer read, and text an attachment must have to count.
ENOUGH, LEAST = 200, 50
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def read_parts(messages: DataFrame) -> DataFrame:
    """Rows (msg_no, part_no, ctype, charset, fname, disp, payload) of raw messages (msg_no, raw), depth first; containers are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for no, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                for k, part in enumerate(email.message_from_bytes(raw).walk()):
                    if not part.is_multipart():
                        rows.append((no, k, part.get_content_type(), part.get_content_charset("utf-8"), decoded(str(part.get_filename())), part.get_content_disposition(), part.get_payload(decode=True)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["msg_no", "part_no", "ctype", "charset", "fname", "disp", "payload"])

    return messages.select(F.col("msg_no").cast("long"), "raw").mapInArrow(run, PART)


def repaired_charset(charset: Column) -> Column:
    """utf-8 for null, iso8859-2 for an empty name, known aliases by their proper names; lower case."""
    low = F.lower(F.trim(charset))
    out = F.when(low.isNull(), "utf-8").when(low == "", "iso8859-2").when(F.startswith(low, F.lit("utf8")), "utf-8")
    for alias, name in CHARSETS.items():
        out = out.when(low == alias, name)
    return out.otherwise(low)


def decode_mixed(data: bytes, charset: str) -> str:
    """Decoded text, in which each byte that the charset cannot decode is read as ISO-8859-2; an unknown charset is UTF-8."""
    try:
        return data.decode(charset, "lettermill-mixed")
    except LookupError:
        return data.decode("utf-8", "lettermill-mixed")


def _register() -> None:
    import codecs

    codecs.register_error("lettermill-mixed", lambda e: (e.object[e.start : e.start + 1].decode("iso8859-2", "ignore"), e.start + 1))


_register()


def docx_to_text(data: bytes) -> str:
    """Text runs of word/document.xml, with a tab for tabs, breaks and paragraphs; entities stay as they are."""
    out = []
    for chunk in zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8").split("<"):
        tag, mark, text = chunk.partition(">")
        name = tag.split()[0] if mark and tag.split() else ""
        if name == "w:t":
            out.append(text)
        elif name in ("w:tab", "w:br", "w:cr", "w:p"):
            out.append("\t")
    return "".join(out)


def pdf_to_text(data: bytes) -> str:
    """The first page of more than 200 characters, else the last; needs an optional library."""
    import pdftotext  # optional

    text = ""
    for page in pdftotext.PDF(io.BytesIO(data)):
        text = str(page)
        if len(text) > ENOUGH:
            break
    return text


def tnef_to_text(data: bytes) -> str:
    """The HTML body's bytes as text, else the RTF body as text; needs an optional library."""
    from tnefparse import TNEF  # optional

    found = TNEF(data)
    page = found.codepage or "cp1250"
    if found.htmlbody:
        try:
            return found.htmlbody.decode("utf-8")
        except UnicodeDecodeError:
            return found.htmlbody.decode(page, "ignore")
    return rtf_to_text(found.rtfbody.decode(page, "ignore")) if found.rtfbody else ""


#: Readers of attachments by kind.
READERS: dict[str, Callable[[bytes], str]] = {"pdf": pdf_to_text, "rtf": lambda d: rtf_to_text(d.decode("utf-8", "ignore")), "docx": docx_to_text, "tnef": tnef_to_text}


def attachment_kind(ctype: Column, fname: Column) -> Column:
    """pdf, rtf, docx or tnef, by type or file name; null for others."""
    c, f = F.lower(F.trim(F.substring_index(ctype, ";", 1))), F.lower(F.coalesce(fname, F.lit("none")))
    return (
        F.when((c == "application/pdf") | F.endswith(f, F.lit(".pdf")), "pdf").when((c == "application/rtf") | F.endswith(f, F.lit(".rtf")), "rtf")
        .when((c == DOCX_TYPE) | F.endswith(f, F.lit(".docx")), "docx").when((c == "application/ms-tnef") | (f == "winmail.dat"), "tnef")
    )


def _read(rows: DataFrame, f: Callable[..., str | None], columns: list[str]) -> DataFrame:
    """Adds text = f(payload, …) row by row in Arrow batches; what cannot be read is null."""

    def run(batches):
        for batch in batches:
            out = []
            for args in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                try:
                    out.append(f(*args))
                except Exception:  # noqa: BLE001  (a broken part is skipped, whatever breaks it)
                    out.append(None)
            yield batch.append_column("text", pa.array(out, pa.string()))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", text string"
    return rows.mapInArrow(run, schema)


def composed(parts: DataFrame) -> DataFrame:
    """Messages (msg_no, raw) put together from parts (msg_no, part_no, ctype, payload), in order, each in base64."""
    import base64

    def run(table: pa.Table) -> pa.Table:
        out = [b"MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=part-of-this-mail\n"]
        table = table.sort_by("part_no")
        for ctype, payload in zip(table.column("ctype").to_pylist(), table.column("payload").to_pylist(), strict=True):
            out.append(b"--part-of-this-mail\nContent-Type: " + (ctype or "text/plain").encode() + b"\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(payload or b""))
        return pa.table({"msg_no": pa.array([table.column("msg_no")[0].as_py()], pa.int64()), "raw": pa.array([b"\n".join([*out, b"--part-of-this-mail--\n"])], pa.binary())})

    return parts.select(F.col("msg_no").cast("long"), "part_no", "ctype", "payload").groupBy("msg_no").applyInArrow(run, "msg_no long, raw binary")


def to_rtf(text: Column) -> Column:
    """A text as the bytes of an RTF document; characters beyond ASCII by their numbers, those beyond 16 bits as they are."""
    plain = F.regexp_replace(text, r"([\\\\{}])", r"\\$1")
    ends = F.regexp_replace(F.regexp_replace(plain, "\n", r"\\par "), "\r", r"\\\r")
    return F.encode(F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\title none}}"), ends, F.lit("}")), "UTF-8")


def to_docx(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, payload) of texts (doc_id, text): a DOCX with a paragraph of one run for each line."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                xml = "".join(f"<w:p><w:r><w:t xml:space='preserve'>{line.replace('<', ' ').replace('>', ' ')}</w:t></w:r></w:p>" for line in text.split("\n"))
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
                    z.writestr("word/document.xml", f"<w:document><w:body>{xml}</w:body></w:document>")
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "payload"])

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, payload binary")


def read_as(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (doc_id, text) of attachments (doc_id, payload) of one kind; what cannot be read is null."""
    return _read(rows.select("doc_id", "payload"), READERS[kind], ["payload"]).select("doc_id", "text")


def candidates(parts: DataFrame) -> DataFrame:
    """Rows (msg_no, cand_no, text): the texts of each message from its parts (msg_no, part_no, ctype, charset, fname, disp, payload).

    An inline HTML part replaces all texts before it, inline plain text adds one, other inline text only counts as
    length. An attachment is read while the longest inline text so far is below 200 characters, and counts from
    51 characters on. Parts that cannot be read are skipped; repeated (msg_no, part_no) count once; null payloads
    are empty. The parts of a message are one window partition.
    """
    parts = parts.dropDuplicates(["msg_no", "part_no"]).withColumn("payload", F.coalesce("payload", F.lit(b"")))
    ctype = F.lower(F.trim(F.substring_index("ctype", ";", 1)))
    base = parts.withColumns({"ctype": ctype, "charset": repaired_charset(F.col("charset")), "kind": attachment_kind(F.col("ctype"), F.col("fname"))})
    inline = F.col("ctype").startswith("text/") & (F.coalesce(F.col("disp"), F.lit("")) != "attachment")
    texts = _read(base.where(inline).select("msg_no", "part_no", "ctype", "charset", "payload"), decode_mixed, ["payload", "charset"]).select("msg_no", "part_no", "ctype", decode_numeric(F.col("text")).alias("text")).where("text is not null")
    texts = cut(texts.withColumn("html", is_html(F.col("text"), F.col("ctype"))).withColumn("pid", F.concat_ws("/", "msg_no", "part_no")))  # read several times below, decoded once
    visible = html_to_text(texts.where("html").withColumn("text", cut_head(F.col("text"))), "pid", "text").select(F.col("id").alias("pid"), F.col("text").alias("visible"))
    texts = cut(texts.join(visible, "pid", "left").withColumn("text", F.when(F.col("html"), F.coalesce("visible", F.lit(""))).otherwise(F.col("text"))))  # HTML is read once
    whole = Window.partitionBy("msg_no")
    upto = whole.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = texts.select("msg_no", "part_no", "html", (F.col("ctype") == "text/plain").alias("plain"), "text", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("binary").alias("payload"))
    others = base.where(~inline & F.col("kind").isNotNull()).select("msg_no", "part_no", F.lit(False).alias("html"), F.lit(False).alias("plain"), F.lit(None).cast("string").alias("text"), "kind", "payload")
    every = rows.unionByName(others).withColumn("before", F.coalesce(F.max(F.length("text")).over(upto), F.lit(0)))
    wanted = every.where((F.col("kind").isNotNull()) & (F.col("before") < ENOUGH)).select("msg_no", "part_no", "kind", "payload")
    attached = _read(wanted, lambda data, kind: READERS[kind](data), ["payload", "kind"]).where(F.length("text") > LEAST).select("msg_no", "part_no", F.lit(False).alias("html"), "text")
    kept = rows.where("html or plain").select("msg_no", "part_no", "html", "text").unionByName(attached)
    last = F.max(F.when(F.col("html"), F.col("part_no"))).over(whole)
    kept = kept.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("part_no") >= F.col("_last")))
    return kept.select("msg_no", (F.row_number().over(whole.orderBy("part_no"))).alias("cand_no"), "text")
