"""RTF to text in three steps: pieces of the source, a tree of groups, and a walk over the tree that writes text."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple


def _family(prefix: str, words: str, *ends: str) -> set[str]:
    return {prefix + w + e for w in words.split() for e in ends or ("",)}


#: Destinations of the RTF specification whose groups hold no visible text, by family. Fixed values.
DESTINATIONS = frozenset(
    # document information and settings
    _family("", "info title subject author manager company operator category keywords comment doccomm hlinkbase creatim revtim printim buptim userprops propname staticval linkval docvar template password passwordhash generator private windowcaption xform datastore factoidname")
    # tables of fonts, colours, styles, revisions, users, files
    | _family("", "fonttbl fontfile fontemb falt panose colortbl colorschememapping stylesheet latentstyles lsdlockedexcept revtbl rsidtbl protusertbl protstart protend filetbl file nextfile xmlnstbl gridtbl themedata defchp defpap pgptbl pgp keycode fchars lchars wgrffmtfilter writereservation writereservhash")
    | _family("old", "c p s t", "props")
    # lists and numbering
    | _family("list", "level name override overridetable picture stylename table text")
    | _family("", "list levelnumbers leveltext lfolevel pn pnseclvl pntext pntxta pntxtb")
    # headers, footers, notes, annotations
    | _family("", "header footer", "", "f", "l", "r")
    | _family("", "ftn aftn", "cn", "sep", "sepc")
    | _family("", "footnote annotation background")
    | _family("atn", "author date icn id parent ref time")
    | _family("atrf", "start end")
    # bookmarks, index and contents
    | _family("bkmk", "start end")
    | _family("", "xe pxe rxe txe tc")
    # fields and forms
    | _family("", "fldinst fldtype datafield formfield")
    | _family("ff", "deftext entrymcr exitmcr format helptext l name stattext")
    # objects, pictures and shapes
    | _family("obj", "alias class data ect name sect time")
    | _family("", "result oleclsid ebcstart ebcend pict picprop shppict blipuid do dptxbxtext sn sp sv svb g hl hlfr hlloc hlsrc hsv fname")
    | _family("shp", "grp inst rslt txt")
    | _family("", "shp htmltag ud upr nesttableprops nonesttables")
    | _family("xml", "attrname attrvalue close name open")
    # mail merge
    | _family("", "mailmerge")
    | _family("mm", "addfieldname connectstr connectstrdata datasource headersource mailsubject odso query")
    | _family("mmodso", "filter fldmpdata mappedname name recipdata sort src table udl udldata uniquetag")
    # mathematics: elements with and without their properties, and single properties
    | _family("m", "acc bar borderBox box d eqArr f func groupChr limlow limupp m mc nary oMathPara phant r rad sPre sSub sSubSup sSup", "", "Pr")
    | _family("m", "aln alnScr argPr baseJc begChr chr count ctrlPr deg degHide den diff e endChr fName grow htmltag lim limloc math mathPict mathPr maxdist mcJc mcs mr noBreak num objDist oMath opEmu plcHide pos sepChr show shp sub subHide sup supHide transp type vertJc vfmf vfml vtof vtol")
    | _family("mhide", "Bot Left Right Top")
    | _family("mstrike", "BLTR H TLBR V")
    | _family("mzero", "Asc Desc Wid")
)
#: What control words and symbols stand for. Fixed values.
WORDS = {
    "par": "\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "|", "nestcell": "|",
    "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "qmspace": " ", "bullet": "•",
    "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”",
}
SYMBOLS = {"~": "\xa0", "-": "\xad", "_": "‑", "{": "{", "}": "}", "\\": "\\", "\n": "\n", "\r": "\r"}

_PLAIN = re.compile(r"[^\\{}\r\n]+")
_CONTROL = re.compile(r"([A-Za-z]{1,32})(-?[0-9]{1,10})? ?")
_OCTETS = re.compile(r"(?:\\'[0-9A-Fa-f]{2})+")
_TARGET = re.compile(r'(?i)HYPERLINK\s+(".*?")')


class Word(NamedTuple):
    """A control word with its number."""

    name: str
    number: int | None


@dataclass
class Group:
    """What stands between two braces: strings, runs of bytes, control words, symbols (as bare words) and groups."""

    items: list = field(default_factory=list)
    closed: bool = False


class Symbol(str):
    """A control symbol."""


def pieces(source: str) -> Iterator[object]:
    """The source in order: Word, Symbol, bytes (of a whole run of \\'xx), "{" and "}" as Group and None, and plain text."""
    at, end = 0, len(source)
    while at < end:
        c = source[at]
        if c == "{" or c == "}":
            yield Group() if c == "{" else None
            at += 1
        elif c in "\r\n":
            at += 1
        elif c != "\\":
            plain = _PLAIN.match(source, at)
            yield plain[0]
            at = plain.end()
        elif run := _OCTETS.match(source, at):
            yield bytes.fromhex(run[0].replace("\\'", ""))
            at = run.end()
        elif control := _CONTROL.match(source, at + 1):
            yield Word(control[1], None if control[2] is None else int(control[2]))
            at = control.end()
        else:
            yield Symbol(source[at + 1 : at + 2])
            at += 2


def tree(source: str) -> Group:
    """The groups of a source. A brace that closes nothing ends the document; one that is never closed ends with it."""
    root = Group()
    open_groups = [root]
    for piece in pieces(source):
        if isinstance(piece, Group):
            open_groups[-1].items.append(piece)
            open_groups.append(piece)
        elif piece is not None:
            open_groups[-1].items.append(piece)
        elif len(open_groups) > 1:
            open_groups.pop().closed = True
        else:
            break
    return root


def _target(group: Group) -> str | None:
    """The quoted target of a field whose instruction is a hyperlink."""
    if not any(isinstance(x, Word) and x.name == "field" for x in group.items[:1]):
        return None
    for part in group.items:
        if isinstance(part, Group) and any(isinstance(x, Word) and x.name == "fldinst" for x in part.items):
            words: list[str] = []
            rest = [part]
            while rest:
                x = rest.pop()
                if isinstance(x, Group):
                    rest.extend(reversed(x.items))
                elif type(x) is str:
                    words.append(x)
            found = _TARGET.search("".join(words))
            return found[1] if found else None
    return None


@dataclass
class _Frame:
    """A group on the way: what is left of it, how many characters stand for one \\u in it, and what its end writes."""

    rest: Iterator[object]
    fallback: int
    behind: str = ""
    closed: bool = False


def rtf_to_text(text: str, encoding: str = "cp1252", errors: str = "strict", hidden: frozenset[str] = DESTINATIONS) -> str:
    """Visible text of an RTF source; a link becomes its text and the target in parentheses.

    Groups of the hidden destinations, and those marked by \\*, are left out from that word on. Bytes are decoded in
    the document's code page, a run at a time; a run that ends the source is lost, as nothing shows that it is whole.
    What is no RTF comes out as plain text.
    """
    root = tree(text)
    out: list[str] = []
    stack = [_Frame(iter(root.items), 1)]
    skip = 0  # characters still to be passed over behind a \u
    octets = b""
    while stack:
        frame = stack[-1]
        item = next(frame.rest, None)
        if item is None:
            # the end of a group closes a run of bytes; the end of the source does not
            if octets and frame.closed:
                out.append(octets.decode(encoding, errors))
                octets = b""
            out.append(frame.behind)
            stack.pop()
            skip = 0
            continue
        if isinstance(item, bytes):
            octets += item[skip:]
            skip = max(0, skip - len(item))
            continue
        if octets:
            out.append(octets.decode(encoding, errors))
            octets = b""
        if isinstance(item, Group):
            target = _target(item)
            stack.append(_Frame(iter(item.items), frame.fallback, f"({target})" if target else "", item.closed))
            skip = 0
        elif isinstance(item, Symbol):
            skip = 0
            if item == "*":
                frame.rest = iter(())
            else:
                out.append(SYMBOLS.get(item, ""))
        elif isinstance(item, Word):
            skip = 0
            if item.name in hidden:
                frame.rest = iter(())
            elif item.name == "u" and item.number is not None:
                out.append(chr(item.number % 0x10000 if item.number < 0 else item.number))
                skip = frame.fallback
            elif item.name == "uc":
                frame.fallback = 1 if item.number is None else item.number
            elif item.name == "ansicpg":
                encoding = f"cp{item.number}"
                try:
                    codecs.lookup(encoding)
                except LookupError:
                    encoding = "utf-8"
            else:
                out.append(WORDS.get(item.name, ""))
        else:
            out.append(item[skip:])
            skip = max(0, skip - len(item))
    return "".join(out)
