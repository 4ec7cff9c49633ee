"""Redaction, entities, accent folding and lexing of text, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that results depend on. Fixed values; the same ones are used by the SQL of lettermill.plans.
URL = r"https? ?: ?//[-._a-zA-Z0-9/?&=]*"
EMAIL = r"[-+$_.a-z0-9]*@[-.a-z0-9]*\.[a-z][a-z]*"
DOMAIN = r"[-0-9a-z]{2,}\.[-0-9a-z]{2,}\.[-0-9a-z]{2,3}"
ENTITY = r"&([^;]+);"
NUMERIC = r"&(#[xX]?[0-9a-fA-F]+);"
#: White space as Python's str.split() has it.
SPACES = "\t\n\u000b\f\r\u001c-\u001f \u0085   -     　"
REPLY = r"(?s)(?:-----|_____|\.{5}|From:|Forwarded|Felad).*"
BOILERPLATE = "pam detection software, running on the system"
#: The lexer, as replacements in order, on folded lower-case text.
LEXER = [
    ("#", " "),
    ("!+", " ! "),
    (";+", " ; "),
    (r"\.+", " . "),
    ("([0-9]+)", " $1"),
    ("([0-9])([a-z])", "$1 $2"),
    ("[0-9]", "#"),
    ("[-_]", ""),
    ("[^a-z#!;.]+", " "),
]


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def redact(text: Column) -> Column:
    """URLs, lower-case e-mail addresses and three-label domains to placeholders, in this order. Null stays null."""
    text = F.regexp_replace(text, URL, "httpurl")
    text = F.regexp_replace(text, EMAIL, "emailaddress")
    return F.regexp_replace(text, DOMAIN, "domainname")


def _map(table: dict[str, str]) -> Column:
    """A map literal, in one expression instead of one call for each entry."""
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")")


def _rebuilt(text: Column, pattern: str, replaced) -> Column:
    """The text with each match of the pattern replaced by a function of its first group, in a single pass."""

    def rebuilt(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), replaced)
        pieces = F.zip_with(F.split(t, pattern, -1), F.concat(found, F.array(F.lit(""))), lambda x, y: F.concat(x, y))
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return let(text, rebuilt)


@cache
def _entities() -> dict[str, str]:
    return {name: chr(code) for name, code in name2codepoint.items()}


def decode_entities(text: Column) -> Column:
    """Named entities to characters; unknown and numeric ones to '?'. Leftmost first, once."""
    table = _map(_entities())
    return _rebuilt(text, ENTITY, lambda name: F.coalesce(F.try_element_at(table, name), F.lit("?")))


def _number(name: Column) -> Column:
    """The code point of '#233', '#xE9' or '#XE9'; null if it is no number."""
    hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
    # leading zeros say nothing about whether a number fits
    digits = F.regexp_replace(F.when(hexadecimal, F.substr(name, F.lit(3))).otherwise(F.substr(name, F.lit(2))), "^0+(?=.)", "")
    fits = F.when(hexadecimal, digits.rlike("^[0-9a-fA-F]{1,7}$")).otherwise(digits.rlike("^[0-9]{1,9}$"))
    return F.when(fits, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))


def decode_numeric(text: Column) -> Column:
    """Numeric entities from code point 128 on to characters, lower ones kept; null if one is malformed or out of range."""

    def replaced(name: Column) -> Column:
        code = _number(name)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code < 128, F.concat(F.lit("&"), name, F.lit(";"))).when(code <= 0x10FFFF, char)

    def checked(t: Column) -> Column:
        names = F.regexp_extract_all(t, F.lit(NUMERIC), F.lit(1))
        bad = F.exists(names, lambda n: _number(n).isNull() | (_number(n) > 0x10FFFF))
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(None).cast("string")).otherwise(_rebuilt(t, NUMERIC, replaced))

    return let(text, checked)


@cache
def fold_table(limit: int = 0x20000) -> dict[str, str]:
    """Characters from 128 on to ASCII, by compatibility decomposition; four that do not decompose are given by hand."""
    table = {}
    for code in range(128, limit):
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if folded and folded != "()":
            table[chr(code)] = folded
    return table | {"×": "x", "Ø": "O", "ø": "o", "ß": "ss"}


def _ranges(chars) -> str:
    """The inside of a character class, as ranges."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


def fold(text: Column, table: dict[str, str] | None = None) -> Column:
    """Accented letters to plain ones, all else beyond ASCII away. Texts that are ASCII already are left alone.

    A table of one's own, such as lettermill.sources.lines.read_confusables gives, replaces the built-in one.
    """
    table = fold_table() if table is None else {k: v for k, v in table.items() if len(k) == 1 and ord(k) > 127}
    single = {k: v for k, v in table.items() if len(v) == 1}
    several = {k: v for k, v in table.items() if len(v) > 1} or {"ß": "ss"}
    pattern = "(?=[^\\x00-\\x7F])([" + _ranges(several) + "])"  # ASCII is passed over by the first test
    pairs = _map(several)

    def widened(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda c: F.element_at(pairs, c))
        pieces = F.zip_with(F.split(t, pattern, -1), F.concat(found, F.array(F.lit(""))), lambda x, y: F.concat(x, y))
        return F.when(t.rlike(pattern), F.array_join(pieces, "")).otherwise(t)

    def folded(t: Column) -> Column:
        plain = F.regexp_replace(F.translate(let(t, widened), "".join(single), "".join(single.values())), r"[^\x00-\x7F]", "")
        return F.when(t.rlike(r"[^\x00-\x7F]"), plain).otherwise(t)

    return let(text, folded)


def lex(text: Column) -> Column:
    """Tokens of folded lower-case text: words, runs of # for digits, and single ! ; . marks."""
    for pattern, to in LEXER:
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.split(text, " "), lambda t: t != "")


def tokenize(text: Column, table: dict[str, str] | None = None) -> Column:
    """Redact, decode entities, fold, lower, lex. Null stays null, empty text gives an empty array. table as for fold()."""
    return lex(F.lower(fold(decode_entities(redact(text)), table)))


def squeeze(text: Column) -> Column:
    """White space and double quotes to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, f'[{SPACES}"]+', " "))


def usable(squeezed: Column) -> Column:
    """More than ten characters, and not a mail about a filter's own finding."""
    return (F.length(squeezed) > 10) & ~F.contains(squeezed, F.lit(BOILERPLATE))


def cut_reply(text: Column) -> Column:
    """The text up to the first mark of a quoted mail."""
    return F.regexp_replace(text, REPLY, "")


def counted_words(text: Column) -> Column:
    """Words of three characters or more whose first is 'A' or a later character."""
    return F.filter(F.split(squeeze(text), " "), lambda w: (F.length(w) >= 3) & (F.ascii(w) >= 65))


def tokenized(rows, text_col: str, out: str = "tokens"):
    """Adds the tokens of a text column. They come out of a generator, so that no later filter computes them again."""
    return rows.select("*", F.explode(F.array(tokenize(F.col(text_col)))).alias(out))
