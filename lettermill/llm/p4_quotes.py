"""Newly written text of e-mails: a recursive layout grammar of quotes, forwards, closings and notices.

    message  = { blank | quoted | forward | closing | signature | notice | written }
    quoted   = [ intro ] marked-line { marked-line }            whose inside is a message again
    forward  = [ separator ] header header { header } rest      whose rest is a message again
    closing  = sign-off { line }          up to a blank line
    signature= delimiter line { line }    up to a blank line; or a lone line that a device adds
    notice   = [ separator ] paragraph    of legal text

Only the written nodes of the outermost message are new.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .p5_encoding import readable, sent_model


def _fold_table() -> dict[int, str]:
    """Accented letters to plain ones, in lower case."""
    table = {0xDF: "ss", 0x2019: "'", 0x2018: "'", 0xA0: " ", 0x0D: None}
    for cp in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if base and base.isascii():
            table.setdefault(cp, base.lower())
    return table


FOLD = _fold_table()
_FOLDED = re.compile("[À-ɏ‘’\xa0\r]")


def folded_text(text: str) -> str:
    """The same as translating by FOLD, but faster for texts with few such letters; lower case."""
    return _FOLDED.sub(lambda m: FOLD.get(ord(m[0]), m[0]) or "", text).lower()



#: Phrases of each language, without accents and in lower case: these are fixed values of the grammar.
SIGN_OFFS = """
udv|udvozlettel|koszonettel|szep napot|tisztelettel|koszonom szepen|baratsaggal
best regards|kind regards|warm regards|regards|cheers|many thanks|sincerely|yours sincerely|yours faithfully|best wishes|all the best|with thanks
viele grusse|schone grusse|mit freundlichen grussen|freundliche grusse|beste grusse|herzliche grusse|besten dank|vielen dank und grusse|mfg
cordialement|bien cordialement|bien a vous|amities|merci d'avance|salutations|sinceres salutations|bien amicalement
un saludo|saludos|saludos cordiales|atentamente|muchas gracias|un cordial saludo|gracias de antemano
cu stima|o zi buna|toate cele bune|multumesc frumos|cu respect|numai bine|cu drag
"""
HEADERS = "from|sent|to|cc|bcc|subject|date|reply-to|felado|elkuldve|cimzett|masolat|targy|datum|von|gesendet|an|kopie|betreff|de|envoye|a|objet|enviado|para|asunto|fecha|de la|trimis|catre|subiect|data"
SENDERS = "from|felado|von|de|de la"
FORWARDED = "eredeti uzenet|tovabbitott (?:level|uzenet)|original message|forwarded message|begin forwarded message|ursprungliche nachricht|weitergeleitete nachricht|message d'origine|message transfere|mensaje original|mensaje reenviado|mesaj original|mesaj redirectionat"
WROTE = "wrote|said the following|irta|schrieb|zitat von|ecrit|disait|escribio|decia|a scris|spunea"
#: Each group is one idea of a legal notice; a paragraph that voices two of them is one.
NOTICES = [
    "confidential|bizalmas|vertraulich|confidentiel|confidencial",
    "addressee|recipient|cimzett|empfanger|adressat|destinat|named above|megnevezett|oben genannte|designee|arriba nombrada|numite? mai sus",
    "liab|felelosseg|haftung|responsab|responde de|raspunde",
    "views|velemeny|ansichten|opinions|opiniones|parerile",
    "statement|nyilatkozat|erklarung|declaration|declaracion|declaratie",
    "delete|torolje|losch|supprim|borre|borrel|elimin|sterge",
    "attached|attachment|mellekle|anlagen|pieces jointes|adjuntos|atasate",
]
DEVICE = (
    r"(?:sent|elkuldve|gesendet|envoye|enviado|trimis)\b.*(?:phone|telefon|handy|movil|mobile|tablet).*"
    r"|(?:von|a)\b.*(?:telefon|handy|phone).*(?:gesendet|kuldve)"
    r"|.*\b(?:on the move|utkozben|unterwegs|en chemin|de camino|din mers)\b.*"
)

_DATE = r"\d{1,4} ?[./-] ?\d{1,2}"
MARK = re.compile(r"[ \t]*(?:[A-Z]{1,3})?>")
SOFT_MARK = re.compile(r"[ \t]*[|:](?=[ >|:\r]|$)")
SIGN_OFF = re.compile("(?:" + SIGN_OFFS.strip().replace("\n", "|") + r")\s*[,:!.]?")
HEADER = re.compile(rf"(?:{HEADERS})\s*:(?:\s|$)")
SENDER = re.compile(rf"(?:{SENDERS})\s*:(?:\s|$)")
BAR = re.compile(r"([-=*_~])\1{2,}\s*([^\W\d_][^=*_~]*?)\s*\1{3,}")
FORWARD = re.compile(FORWARDED)
INTRO = re.compile(rf"(?=.*(?:{WROTE}))(?=.*{_DATE}).*:")
DATED = re.compile(rf".*{_DATE}.*:")
SLASHED = re.compile(r"/ \S.{0,48} /")
SIGNATURE_BAR = re.compile(r"--|__|~{4,}|={6,}|_{3,}")
NOTICE = [re.compile(n) for n in NOTICES]
LONE = re.compile(DEVICE)
#: A tag at its start that makes a document HTML, whatever its type says; stray tags elsewhere do not.
HTML = re.compile(r"(?i)\s*<(?:!doctype|html|head|body|meta|title|style|script|div|p|h[1-6]|table|tbody|tr|td|ul|ol|li|pre|center|span|blockquote)\b[^<>]*>")


@dataclass
class Node:
    """A piece of a message: lines [start, end), and what is inside it."""

    kind: str
    start: int
    end: int
    inside: list["Node"] = field(default_factory=list)


def _is_notice(paragraph: str) -> bool:
    return sum(1 for n in NOTICE if n.search(paragraph)) >= 2


def parse(lines: list[str], folded: list[str] | None = None, deep: bool = True) -> list[Node]:
    """The nodes of a message, in order; written text is left out. With deep the insides are parsed too."""
    if folded is None:
        folded = folded_text("\n".join(lines)).split("\n")
    nodes: list[Node] = []
    n, i, fresh = len(lines), 0, True  # fresh: at the start of a paragraph
    bare = [s.strip() for s in folded]

    def until_blank(k: int) -> int:
        while k < n and bare[k] and not MARK.match(lines[k]):
            k += 1
        return k

    def following(k: int) -> int:
        while k < n and not bare[k]:
            k += 1
        return k

    def intro(k: int, soft: bool) -> int | None:
        """Where the lines that introduce a quote in line k start, if there are any; soft marks need them."""
        at = k
        while at > 0 and bare[at - 1] and k - at < 5 and not MARK.match(lines[at - 1]):
            at -= 1
        if at < k <= at + 4 and INTRO.fullmatch(" ".join(bare[at:k])) and len(" ".join(bare[at:k])) < 200:
            return at
        for size in range(1, min(4, k) + 1):
            joined = " ".join(bare[k - size : k])
            if not bare[k - size]:
                break
            if INTRO.fullmatch(joined) and len(joined) < 200:
                return k - size
        if not soft and k and DATED.fullmatch(bare[k - 1]) and len(bare[k - 1]) < 120:
            return k - 1
        return None

    while i < n:
        s = bare[i]
        if not s:
            fresh, i = True, i + 1
            continue
        line, c = lines[i], s[0]
        strong = ">" in line[:12] and MARK.match(line)
        if strong or (c in "|:" and SOFT_MARK.match(line)):
            start = intro(i, not strong)
            # a lone colon may be the end of an introduction that was wrapped
            if start is None and s == ":" and i + 1 < n and SOFT_MARK.match(lines[i + 1]):
                start = intro(i + 1, True)
            if strong or start is not None:
                mark = MARK if strong else SOFT_MARK
                end = i
                while end < n and bare[end] and mark.match(lines[end]):
                    end += 1
                inside = parse([mark.sub("", x, count=1) for x in lines[i:end]], None, True) if deep else []
                nodes.append(Node("quoted", i if start is None else start, end, inside))
                i, fresh = end, True
                continue
        if c in "-=*_~" and (bar := BAR.fullmatch(s)):
            k = following(i + 1)
            if FORWARD.search(bar[2]) or (k < n and SENDER.match(bare[k])):
                nodes.append(Node("forward", i, n, _rest(lines, folded, k, deep)))
                break
        if ":" in s[:12] and SENDER.match(s):
            k = i
            while k < n and HEADER.match(bare[k]):
                k += 1
            if k - i >= 2 and any(re.search(_DATE, x) for x in bare[i:k]):
                nodes.append(Node("forward", i, n, _rest(lines, folded, i, deep)))
                break
        if fresh:
            end = until_blank(i)
            if SIGN_OFF.fullmatch(s):
                nodes.append(Node("closing", i, end))
                i = end
                continue
            if not re.search(r"\w", s) or SIGNATURE_BAR.fullmatch(s):
                k = following(i + 1)
                if k + 1 < n and SENDER.match(bare[k]) and HEADER.match(bare[k + 1]):
                    nodes.append(Node("forward", i, n, _rest(lines, folded, k, deep)))
                    break
                if k < n and _is_notice(" ".join(bare[k : until_blank(k)])):
                    nodes.append(Node("notice", i, until_blank(k)))
                    i = until_blank(k)
                    continue
                if SIGNATURE_BAR.fullmatch(s) and (k == i + 1 or k >= n) and end - i <= 8 and all(len(x) < 90 for x in bare[i:end]):
                    nodes.append(Node("signature", i, end))
                    i = end
                    continue
            if SLASHED.fullmatch(s) or (LONE.fullmatch(s) and len(s) < 70 and end - i <= 2):
                nodes.append(Node("signature", i, end))
                i = end
                continue
            if (c.isalpha() or c in "*[(") and _is_notice(" ".join(bare[i:end])):
                nodes.append(Node("notice", i, end))
                i = end
                continue
        elif (c == "-" or c == "_" or c == "~" or c == "=") and SIGNATURE_BAR.fullmatch(s):
            end = until_blank(i)
            if 1 < end - i <= 8 and all(len(x) < 70 for x in bare[i:end]) and (s in ("--", "__") or following(end) >= n):
                nodes.append(Node("signature", i, end))
                i = end
                continue
        fresh, i = False, i + 1
    return nodes


def _rest(lines: list[str], folded: list[str], k: int, deep: bool) -> list[Node]:
    """The message behind the headers that start in line k."""
    if not deep:
        return []
    while k < len(lines) and folded[k].strip():
        k += 1
    return parse(lines[k:], folded[k:], True)


def old_lines(text: str) -> list[int]:
    """Numbers, from 1, of the lines of an e-mail that are not blank and not newly written."""
    lines = text.split("\n")
    folded = (text.lower() if text.isascii() else folded_text(text)).split("\n")
    out: list[int] = []
    for node in parse(lines, folded, deep=False):
        out += [k + 1 for k in range(node.start, node.end) if lines[k].strip()]
    return sorted(set(out))


def written(text: str, read: str | None = None) -> str:
    """Only the newly written lines, without the blank ones at either end; read is the text as restored, line by line."""
    old = set(old_lines(text if read is None else read))
    kept = [line for k, line in enumerate(text.split("\n"), 1) if k not in old]
    return re.sub(r"(?:[ \t\r]*\n){3,}", "\n\n", "\n".join(kept)).strip()


def not_written(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, line_no): lines, counted from 1, that are not blank and not newly written by the sender.

    Documents that are HTML inside, null ids, and null or empty texts give no row.
    """
    sent = sent_model(samples)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        found = [[] if "<" in t and HTML.match(t) else old_lines(t) for t in readable(sent.value, texts)]
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
        return {"doc_id": pa.array(ids, pa.int64()), "line_no": pa.array([k for x in found for k in x], pa.int64())}

    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long"), F.col(text_col))
    return map_arrow(rows, run, "doc_id long, line_no long").distinct()


def newly_written(docs: DataFrame, samples: DataFrame | Broadcast | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, written): each e-mail reduced to what its sender newly wrote; HTML is left as it is, null stays null.

    With samples of clean text the lines of garbled documents are told by the restored text; they are kept as they stand.
    """
    sent = None if samples is None else sent_model(samples)

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        some = [t for t in texts if t is not None]
        read = iter(some if sent is None else readable(sent.value, some))
        out = []
        for t in texts:
            r = None if t is None else next(read)
            out.append(t if t is None or ("<" in r and HTML.match(r)) else written(t, r))
        return {"doc_id": batch.column(0), "written": pa.array(out, pa.string())}

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, written string")
