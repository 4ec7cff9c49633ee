"""Address book from mail headers."""

from __future__ import annotations

import re
from email.header import decode_header, make_header

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["from", "to", "cc", "bcc", "reply-to"]
ALLOWED = re.compile(r"[.@_~=!#$%&*/+\-0-9A-Za-z]*")
PAIRS = [('"', '"'), ("'", "'"), ("(", ")"), ("[", "]"), ("{", "}")]


def scan(text: str):
    """Characters of a header with their state: (character, escaped, in quotes, depth of parentheses, depth of angles before it)."""
    quoted, escaped, depth, angle = False, False, 0, 0
    for c in text:
        state = (c, escaped, quoted, depth, angle)
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            angle += (c == "<") - (c == ">")
        yield state


def clean_spaces(text: str) -> str:
    """Runs of white space outside quotes, comments and angles become one blank."""
    out: list[str] = []
    for c, escaped, quoted, depth, angle in scan(text):
        free = not escaped and c != "\\" and not (quoted if c != '"' else not quoted)
        if free and c in "\t\r\n":
            c = " "
        closes = (c == ")") - (c == "("), (c == ">") - (c == "<")
        if free and c == " " and out and out[-1] == " " and depth - closes[0] == 0 and angle - closes[1] == 0:
            continue
        out.append(c)
    return "".join(out).strip()


def split_items(text: str, sep: str = ",") -> list[str]:
    """Pieces between separators that stand outside quotes and comments, trimmed."""
    out, piece = [], []
    for c, escaped, quoted, depth, _ in scan(text):
        if c == sep and not escaped and not quoted and depth == 0:
            out.append("".join(piece).strip())
            piece = []
        else:
            piece.append(c)
    return [*out, "".join(piece).strip()]


def item_parts(item: str) -> tuple[str, str, str]:
    """An item's name, comments with their parentheses, and addresses with their angles."""
    name, comment, address = [], [], []
    for c, escaped, quoted, depth, angle in scan(item):
        special = not escaped and not quoted
        if special and (depth > 0 or c in "()"):
            comment.append(c)
        elif special and (angle > 0 or c in "<>"):
            address.append(c)
        elif depth > 0:
            comment.append(c)
        elif angle > 0:
            address.append(c)
        else:
            name.append(c)
    return clean_spaces("".join(name)), "".join(comment), "".join(address)


def strip_layers(text: str) -> str:
    """Blanks, then one layer each of "", '', (), [] and {}, in this order."""
    text = text.strip(" ")
    for a, b in PAIRS:
        if len(text) >= 2 and text[0] == a and text[-1] == b:
            text = text[1:-1]
    return text.strip(" ")


def address(text: str) -> str | None:
    """A valid address without its angles; <> and MAILER-DAEMON are ones too."""
    if "@" not in text:
        return text if text == "<>" else "MAILER-DAEMON" if text.upper() == "MAILER-DAEMON" else None
    if text[0] == "<" and text[-1] == ">":
        text = text[1:-1].rstrip(" ")
    return text if ALLOWED.fullmatch(text) and text.count("@") == 1 else None


def decoded(value: str) -> str:
    """A header value with its encoded words decoded; as it is if that fails."""
    try:
        return str(make_header(decode_header(value)))
    except Exception:  # noqa: BLE001  (any malformed word)
        return value


def parse_list(value: str) -> list[tuple[str | None, str | None, str | None]]:
    """The items (address, name, error) of an address header."""
    out: list[tuple[str | None, str | None, str | None]] = []
    for item in split_items(clean_spaces(value)):
        if not item:
            continue
        if " " not in item and "<" not in item:
            found, name = address(item), None
        else:
            plain, comment, angled = item_parts(item)
            if angled:
                found, name = address(angled), strip_layers(decoded(strip_layers(clean_spaces(plain))))
            else:
                found, name = address(plain), strip_layers(comment)
        out.append((found, name if name and name != found else None, None if found else item))
    return out


def addresses(headers: DataFrame) -> DataFrame:
    """Rows (msg_no, seq, item, hdr, addr, name, error) of header lines (msg_no, seq, name, value).

    Names of headers are matched without case; other headers, and null names or values, give no row; repeated
    (msg_no, seq) count once; an invalid item has a null address and the item as error.
    """
    rows = headers.where("name is not null and value is not null").select("msg_no", "seq", F.lower(F.trim("name")).alias("hdr"), "value").where(F.col("hdr").isin(FIELDS)).dropDuplicates(["msg_no", "seq"])

    def run(batches):
        for batch in batches:
            out = [(m, s, k, h, a, n, e) for m, s, h, v in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (a, n, e) in enumerate(parse_list(v))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4), strict=True)], names=["msg_no", "seq", "item", "hdr", "addr", "name", "error"])

    return rows.mapInArrow(run, "msg_no long, seq int, item int, hdr string, addr string, name string, error string")


def address_book(found: DataFrame) -> DataFrame:
    """Rows (addr, name, hdrs): of each address, without case, the last name seen in a from header, else the first name seen, and all headers in order.

    hdrs lists every occurrence, so its length is that of the address's own history.
    """
    order = F.struct("msg_no", "seq", "item")
    named = F.col("name").isNotNull()
    book = found.where("addr is not null").groupBy(F.lower("addr").alias("addr")).agg(
        F.max_by("name", F.when(named & (F.col("hdr") == "from"), order)).alias("last_from"),
        F.min_by("name", F.when(named, order)).alias("first"),
        F.array_sort(F.collect_list(F.struct("msg_no", "seq", "item", "hdr"))).alias("h"),
    )
    return book.select("addr", F.coalesce("last_from", "first").alias("name"), F.array_join(F.col("h.hdr"), ",").alias("hdrs"))


def events(found: DataFrame) -> DataFrame:
    """Rows (msg_no, seq, item, line): NAME[hdr]=… for every named occurrence, ADDR[hdr]=… for the first one of an address."""
    valid = found.where("addr is not null")
    names = valid.where("name is not null").select("msg_no", "seq", "item", F.concat(F.lit("NAME["), "hdr", F.lit("]="), "name").alias("line"))
    first = valid.groupBy(F.lower("addr").alias("a")).agg(F.min(F.struct("msg_no", "seq", "item", "hdr")).alias("f"))
    return names.unionByName(first.select("f.msg_no", "f.seq", "f.item", F.concat(F.lit("ADDR["), F.col("f.hdr"), F.lit("]="), "a").alias("line")))
