"""Markup residue: which kinds a document holds, and the document as clean text that keeps its structure.

A classifier of lines, fitted on texts into which markup and what looks like it were put, gives the terminal capacities
of a minimum cut; neighbouring lines pull each other along (smoothness edges). A line with a strong pattern outweighs its
edges. Lines that only weak patterns match (list items, table rows, short formulas) depend on their neighbours: by itself
the first line of a list looks like the first of two dashes that are no list, and the cut decides for whole runs. In HTML,
another cut separates blocks of content from boilerplate, with edges between neighbouring blocks and between blocks of the
same parent element.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .mincut import label
from .p4_quotes import FOLD, FORWARD

#: Element names of HTML. Fixed values; ref and nowiki belong to wikis.
TAGS = "html|head|body|title|meta|link|base|style|script|noscript|div|p|span|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|caption|colgroup|col|tbody|thead|tfoot|tr|td|th|a|abbr|b|i|u|s|em|strong|small|big|sub|sup|font|center|strike|tt|kbd|samp|var|cite|q|mark|del|ins|img|figure|figcaption|picture|video|audio|source|iframe|object|embed|canvas|svg|path|pre|code|blockquote|address|form|input|button|select|option|textarea|label|fieldset|section|article|aside|nav|header|footer|main|details|summary|time|math|mi|mo|mn|mrow|mfrac|msup|msub|msqrt|wbr|area|map|marquee|blink"
_TAG = rf"</?(?:{TAGS}|[a-z]+:[a-z]+)\b(?:\s[^<>]*|\s*/?)>"
_NAMES = frozenset(n[:-1] for n in html5 if n.endswith(";"))

#: Strong and weak patterns of each kind.
PATTERNS: dict[str, tuple[re.Pattern, re.Pattern | None]] = {
    "html": (re.compile(rf"(?i){_TAG}|<!--|<!\[|<!doctype|\]-->|&(?:#\d{{2,7}}|#x[0-9a-f]{{2,6}}|([a-z][a-z0-9]{{1,30}}));"), None),
    "markdown": (
        re.compile(
            r"^ {0,3}#{1,6} +(?!\[\[|[*#:;] )[^\W\d_].*$"
            r"|(?<![*\w])\*\*[^*\s](?:[^*\n]*[^*\s])?\*\*(?![*\w])"
            r"|(?<![_\w])__(?![A-Z]+__)[^_\s](?:[^_\n]*[^_\s])?__(?![_\w])"
            r"|^ {0,3}(?:```|~~~)[\w+-]*[ \t\r]*$"
            r"|(?<!`)`[^`\n]+`(?!`)"
            r"|!?\[[^\[\]\n]*\]\((?:https?:|mailto:|/|#|\.)[^()\s]*\)"
            r"|^\|?[ \t]*:?-{3,}:?[ \t]*\|[ |:\-\t]*\r?$"
            r"|^ {0,3}[-*+] \[[ xX]\] \S"
            r"|(?<![*\w])\*[^\W_](?:[^*\n.;]{0,58}[^\W_])?\*(?![*\w])|(?<![_\w])_[^\W_](?:[^_\n.;]{0,58}[^\W_])?_(?![_\w])"
            r"|(?:^|(?<=\n))(?=([^\W_][^\n]{1,60}?)\r?\n(?P<bar>={3,}|-{3,})\r?$)",
            re.M,
        ),
        re.compile(r"^ {0,3}(?:[-*+]|\d{1,2}[.)]) \S|^\|.*\|[ \t\r]*$", re.M),
    ),
    "wiki": (
        re.compile(
            r"^(={2,6})[ \t]*(?P<title>[^=\s][^=\n]*?)[ \t]*\1[ \t\r]*$"
            r"|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^\{\|.*$|^\|\}[ \t\r]*$"
            r"|(?<!')'{2,3}(?!')[^'\n]+(?:'[^'\n]+)*'{2,3}(?!')|\[https?://[^\s\]]+ [^\]\n]+\]|</?(?:ref|nowiki|gallery)\b[^<>]*>|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^#REDIRECT\b",
            re.M,
        ),
        re.compile(r"^\|-[ \t\r]*$|^[*#;:]+ ?\S|^\|.*$", re.M),
    ),
    "latex": (
        re.compile(
            r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|\\(?:item|maketitle|tableofcontents|noindent|hline|centering|par|newpage|LaTeX|TeX|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|theta|omega|phi|leq?|geq?|neq|approx|cdot|times|sum|int|prod|infty|partial|nabla|ldots|rightarrow|left|right)(?![a-zA-Z])"
            r"|\\[\[\]()](?=.*[\\^_={])|(?<![\w$\\])\$(?![\s\d])[^$\n]{0,120}[\\^_{][^$\n]{0,120}\$(?!\d)|\$\$[^$\n]+\$\$"
        ),
        re.compile(r"(?<![\w$\\])\$(?![\s\d])[^$\n]{1,60}\$(?![\w\d])"),
    ),
}
_NEEDS = {"html": ("<", "&"), "markdown": ("#", "*", "_", "```", "~~~", "`", "](", "---", "===", "] "), "wiki": ("==", "[[", "{{", "{|", "''", "[http", "<ref", "__", "#R"), "latex": ("\\", "$")}
#: A line of mail headers, whatever its language or charset.
_HEADERISH = re.compile(r"[ \t]*[^\W\d_][^:\n]{0,16}: ?\S")


def _separates(text: str, m: re.Match) -> bool:
    """Whether what looks like a wiki heading is a mail's separator: it says so, or header lines follow."""
    if FORWARD.search(m["title"].translate(FOLD).lower()):
        return True
    after = text[m.end() :].lstrip("\r\n ").split("\n", 2)[:2]
    return len(after) == 2 and all(_HEADERISH.match(x) and len(x) < 80 for x in after)


def _counts(kind: str, text: str, m: re.Match) -> bool:
    """Whether a match of a strong pattern is what it looks like."""
    if kind == "html":
        return m[1] is None or m[1] in _NAMES
    if kind == "markdown" and m["bar"]:
        title = m[1].strip()
        before = text[: m.start()].rstrip(" \t\r")
        return abs(len(title) - len(m["bar"])) <= 1 and (not before or before.endswith("\n")) and not FORWARD.search(title.translate(FOLD).lower())
    if kind == "wiki" and m["title"]:
        return not _separates(text, m)
    return True


_NUMBERED = re.compile(r" {0,3}(\d{1,2})([.)]) \S")
_BULLET = re.compile(r" {0,3}([-*+]) \S")
_NESTED = re.compile(r"(\*{1,4}) ?(?!.*\*\*)[^\s*]")


def _alike(kind: str, a: str, b: str) -> bool:
    """Whether a weak line b goes on like the weak line a before it; quote marks of mail never do."""
    if kind == "markdown":
        x, y = _NUMBERED.match(a), _NUMBERED.match(b)
        if x and y:
            return x[2] == y[2] and int(y[1]) - int(x[1]) in (0, 1)
        x, y = _BULLET.match(a), _BULLET.match(b)
        if x and y:
            return x[1] == y[1]
        return a[0] == b[0] == "|" and a.count("|") == b.count("|") > 2
    if kind == "wiki":
        if a[0] in ";:" and b[0] in ";:":
            return ";" in a[0] + b[0]
        if a[0] == b[0] == "|":
            return ("||" in a and "||" in b) or (a.strip() == "|-") != (b.strip() == "|-")
        x, y = _NESTED.match(a), _NESTED.match(b)
        # a flat list is Markdown as well; stars are nested in wikis only
        return bool(x and y and len(x[1] + y[1]) > 2)
    return True


#: Runs of markup and runs that are none, from which the classifier learns: (pattern of a line, whether it is markup, lines of
#: the run at least and at most). {n} counts up.
RUNS = [
    ("- {w}", True, 3, 8), ("{n}. {w}", True, 3, 8), ("| {w} | {w} |", True, 3, 6), ("* {w}", True, 3, 8), ("# {w}", True, 1, 1), ("**{w}** {w}", True, 1, 2),
    ("- {w}", False, 1, 2), ("{n}. {w}", False, 1, 2), ("| {w}", False, 1, 5), ("* {w}", False, 1, 2), ("2{n}. 1. 1999", False, 1, 1), ("{w} - {w}", False, 1, 4), ("> {w}", False, 1, 4), ("--", False, 1, 1),
]
WORDS = "letter answer office order list delivery page table figure report meeting address number station garden window bottle paper".split()


def _drawn(n: int, seed: int = 6) -> Iterator[tuple[list[str], list[bool]]]:
    """Texts as lines, with the label of each: runs among plain lines."""
    rng = random.Random(seed)
    some = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(1, 6)))
    for _ in range(n):
        lines, labels = [], []
        for _ in range(rng.randrange(1, 4)):
            for _ in range(rng.randrange(1, 4)):
                lines.append(some().capitalize() + ".")
                labels.append(False)
            line, markup, least, most = rng.choice(RUNS)
            for k in range(rng.randrange(least, most + 1)):
                lines.append("".join(some() if x == "{w}" else str(k + 1) if x == "{n}" else x for x in re.split(r"(\{[wn]\})", line)))
                labels.append(markup)
        yield [*lines, some().capitalize() + "."], [*labels, False]


def _features(kind: str, lines: list[str], weak: set[int], strong: set[int]) -> list[tuple[int, ...]]:
    """Of each line: whether a strong pattern matches, a weak one, and whether one or both neighbours go on like it."""
    like = [0] * (len(lines) + 1)
    for k in range(len(lines) - 1):
        if k in weak and k + 1 in weak and _alike(kind, lines[k], lines[k + 1]):
            like[k] += 1
            like[k + 1] += 1
    return [(1, k in strong, k in weak, like[k] == 1, like[k] == 2) for k in range(len(lines))]


@cache
def costs() -> tuple[tuple[float, ...], float]:
    """Weights of the features, by logistic regression on drawn texts, and the weight of an edge: of those tried the one whose cuts agree best with the labels."""
    strong, weak = PATTERNS["markdown"]
    texts = []
    for lines, labels in _drawn(400):
        texts.append((_features("markdown", lines, {k for k, x in enumerate(lines) if weak.search(x)}, {k for k, x in enumerate(lines) if strong.search(x)}), labels))
    x, y = np.array([f for t, _ in texts for f in t], float), np.array([v for _, t in texts for v in t], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (p - y) + 0.3 * w)
    wrong = {}
    for edge in (0.1, 0.3, 0.5, 0.8, 1.2, 1.6):
        wrong[edge] = sum(a != b for t, labels in texts for a, b in zip(label((np.array(t) @ w).tolist(), [(k, k + 1, edge) for k in range(len(t) - 1)]), labels, strict=True))
    return tuple(w.tolist()), min(wrong, key=wrong.get)


def kinds(text: str) -> list[str]:
    """The kinds of markup in a text: html, markdown, wiki, latex."""
    out = []
    for kind, (strong, weak) in PATTERNS.items():
        if not any(x in text for x in _NEEDS[kind]) and (weak is None or not weak.search(text)):
            continue
        weights, edge = costs()
        # a line with a strong pattern that outweighs both its edges needs no cut
        sure = weights[0] + weights[1] > 2 * edge
        if (sure and any(_counts(kind, text, m) for m in strong.finditer(text))) or (weak is not None and any(labelled(kind, text))):
            out.append(kind)
    return out


def labelled(kind: str, text: str) -> list[bool]:
    """Which of the lines that are not blank are markup of that kind: a minimum cut over the lines, between two plain ones."""
    strong, weak = PATTERNS[kind]
    starts = {text.rfind("\n", 0, m.start()) + 1 for m in weak.finditer(text)} if weak is not None else set()
    marked = {text.rfind("\n", 0, m.start()) + 1 for m in strong.finditer(text) if _counts(kind, text, m)}
    if not starts and not marked:
        return []
    lines, weak_lines, strong_lines, at = [""], set(), set(), 0
    for line in text.split("\n"):
        if line.strip():
            if at in starts:
                weak_lines.add(len(lines))
            if at in marked:
                strong_lines.add(len(lines))
            lines.append(line)
        at += len(line) + 1
    lines.append("")
    weights, edge = costs()
    votes = [sum(w * f for w, f in zip(weights, fs, strict=True)) for fs in _features(kind, lines, weak_lines, strong_lines)]
    if max(votes) <= 0:
        return [False] * (len(lines) - 2)
    return label(votes, [(k, k + 1, edge) for k in range(len(lines) - 1)])[1:-1]


def with_markup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, kind): each kind of markup that a document holds.

    Quote marks, separators, header lines and signature marks of mail are no markup. Null ids and null or empty
    texts give no row; repeated rows give one.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = [kinds(t) for t in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
        return {"doc_id": pa.array(ids, pa.int64()), "kind": pa.array([k for x in found for k in x], pa.string())}

    # a character of markup at least must stand in the text
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[<&#*_`\[\]{}\\$'=~|-]")).select(F.col(id_col).cast("long"), F.col(text_col))
    return map_arrow(rows, run, "doc_id long, kind string").distinct()


# --- conversion -------------------------------------------------------------------------------------------

_PIECE = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<!\[.*?\]>|<!\w[^>]*>|<(/?)([a-zA-Z][\w:]*)([^<>]*)>|[^<]+|<")
_BLOCKS = frozenset("address article aside blockquote body br center dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source wbr".split())
_HIDDEN = re.compile(r"(?i)(?:[^-]|^)color:\s*#?(?:fff(?:fff)?|white)\b|font-size:\s*[0-5](?:px|pt)|display:\s*none|visibility:\s*hidden")


def blocks(text: str) -> list[dict]:
    """An HTML text's blocks in order: text, kind (text, heading, item, code, formula), parent element, link share, hidden."""
    out: list[dict] = []
    stack: list[tuple[str, int, bool]] = []
    serial, dead = 0, ""
    words: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal words, linked
        raw = html.unescape("".join(words)).replace("\xa0", " ")
        tags = [t for t, _, _ in stack]
        code = "pre" in tags
        body = raw.strip("\n") if code else re.sub(r"\s+", " ", raw).strip()
        if body.strip():
            heading = next((t for t in tags if re.fullmatch("h[1-6]", t)), None)
            kind = "code" if code else "heading" if heading else "title" if "title" in tags else "formula" if "math" in tags else "item" if "li" in tags else "text"
            parents = [n for t, n, _ in stack if t in _BLOCKS]
            out.append({"text": body, "kind": kind, "level": int(heading[1]) if heading else 0, "parent": parents[-2] if len(parents) > 1 else 0, "links": linked / max(1, len(raw)), "hidden": any(h for _, _, h in stack), "nav": any(t in ("nav", "footer", "aside", "header", "head") for t in tags)})
        words, linked = [], 0

    for m in _PIECE.finditer(text):
        piece, name = m[0], (m[2] or "").lower()
        if dead:
            if name == dead and m[1]:
                dead = ""
            continue
        if not name:
            if piece.startswith("<!"):
                continue
            words.append(piece)
            if stack and any(t == "a" for t, _, _ in stack):
                linked += len(piece)
            continue
        if name in ("script", "style") and not m[1]:
            dead = name
            continue
        boundary = name in _BLOCKS or name in ("math",)
        if boundary and not (name == "br" and any(t == "pre" for t, _, _ in stack)):
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in _VOID and not m[3].endswith("/"):
            serial += 1
            if name in ("li", "p", "td", "tr") and stack and stack[-1][0] == name:
                stack.pop()
            stack.append((name, serial, bool(_HIDDEN.search(m[3]))))
    flush()
    return out


def content(found: list[dict]) -> list[bool]:
    """Which blocks are content: a minimum cut over neighbours and children of one element."""
    unary, edges, last = [], [], {}
    for k, b in enumerate(found):
        n = len(b["text"])
        vote = min(2.0, n / 60) + (1.0 if re.search(r"[.!?;:]", b["text"]) else -0.3) - 3.0 * b["links"]
        vote += {"heading": 1.5, "code": 3.0, "formula": 3.0, "item": 0.8, "title": -2.0}.get(b["kind"], 0.0)
        vote -= 8.0 * b["hidden"] + 2.0 * b["nav"]
        unary.append(vote)
        if k:
            edges.append((k - 1, k, 0.5))
        if b["parent"] in last and last[b["parent"]] != k - 1:
            edges.append((last[b["parent"]], k, 0.3))
        last[b["parent"]] = k
    return label(unary, edges)


def html_to_text(text: str) -> str:
    found = blocks(text)
    lines = []
    for b, keep in zip(found, content(found), strict=True):
        if not keep:
            continue
        if b["kind"] == "heading":
            lines.append("#" * b["level"] + " " + b["text"])
        elif b["kind"] == "item":
            lines.append("- " + b["text"])
        elif b["kind"] == "code":
            lines.append("```\n" + b["text"] + "\n```")
        elif b["kind"] == "formula":
            lines.append("$" + re.sub(r"\s+", " ", b["text"]) + "$")
        else:
            lines.append(b["text"])
    return "\n".join(lines)


def _fences(text: str) -> list[tuple[bool, str]]:
    """Code blocks apart from the rest: pairs (is code, text)."""
    out, at = [], 0
    for m in re.finditer(r"(?ms)^ {0,3}(```|~~~)[\w+-]*[ \t\r]*\n(.*?)^ {0,3}\1[ \t\r]*$", text):
        out += [(False, text[at : m.start()]), (True, m[2].rstrip("\n"))]
        at = m.end()
    return [*out, (False, text[at:])]


def markdown_to_text(text: str) -> str:
    def prose(t: str) -> str:
        t = re.sub(r"(?m)^([^\W_][^\n]{1,60}?)\r?\n(={3,}|-{3,})\r?$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1] if abs(len(m[1].strip()) - len(m[2])) <= 1 else m[0], t)
        t = re.sub(r"!?\[([^\[\]\n]*)\]\((?:https?:|mailto:|/|#|\.)[^()\s]*\)", r"\1", t)
        t = re.sub(r"(?<![*\w])\*\*([^*\s](?:[^*\n]*[^*\s])?)\*\*(?![*\w])|(?<![_\w])__(?![A-Z]+__)([^_\s](?:[^_\n]*[^_\s])?)__(?![_\w])", lambda m: m[1] or m[2], t)
        t = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", t)
        t = re.sub(r"(?<![*\w])\*([^\W_](?:[^*\n.;]{0,58}[^\W_])?)\*(?![*\w])|(?<![_\w])_([^\W_](?:[^_\n.;]{0,58}[^\W_])?)_(?![_\w])", lambda m: m[1] or m[2], t)
        t = re.sub(r"(?m)^( {0,3})[-*+] (?:\[[ xX]\] )?(?=\S)", r"\1- ", t)
        return re.sub(r"(?m)^\|?[ \t]*:?-{3,}:?[ \t]*\|[ |:\-\t]*\r?\n?", "", t)

    return "".join(f"```\n{t}\n```" if code else prose(t) for code, t in _fences(text))


def wiki_to_text(text: str) -> str:
    t = re.sub(r"(?m)^([*#;:]+) ?(?=\S)", lambda m: "  " * (len(m[1]) - 1) + "- ", text)
    t = re.sub(r"(?m)^(={2,6})[ \t]*([^=\s][^=\n]*?)[ \t]*\1[ \t\r]*$", lambda m: "#" * len(m[1]) + " " + m[2] if not FORWARD.search(m[2].translate(FOLD).lower()) else m[0], t)
    t = re.sub(r"(?s)<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|</?nowiki>", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"\{\{([^{}\n]+)\}\}", lambda m: " ".join(m[1].split("|")[1:]), t)
    t = re.sub(r"(?<!')'{2,3}(?!')((?:[^'\n]|'(?!'))+)'{2,3}(?!')", r"\1", t)
    t = re.sub(r"(?m)^\{\|.*\n?|^\|\}[ \t\r]*\n?|^\|-.*\n?", "", t)
    return re.sub(r"(?m)^[|!] ?(.*\|\|.*|[^|\n]*)$", lambda m: m[1].replace("||", "|"), t)


def latex_to_text(text: str) -> str:
    level = {"chapter": "#", "section": "##", "subsection": "###", "subsubsection": "####"}
    t = re.sub(r"\\(chapter|section|subsection|subsubsection)\*?\{([^{}]*)\}", lambda m: level[m[1]] + " " + m[2], text)
    t = re.sub(r"(?s)\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: "```" + m[2] + "```", t)
    t = re.sub(r"(?s)\\begin\{(equation|align|displaymath)(\*?)\}\s*(.*?)\s*\\end\{\1\2\}", lambda m: "$" + re.sub(r"\s*\\label\{[^{}]*\}", "", m[3]) + "$", t)
    t = re.sub(r"(?s)\\\[\s*(.*?)\s*\\\]|\\\(\s*(.*?)\s*\\\)", lambda m: "$" + (m[1] or m[2] or "") + "$", t)
    parts = re.split(r"(?s)(\$[^$\n]*[\\^_{][^$\n]*\$|```.*?```)", t)
    for k in range(0, len(parts), 2):
        p = re.sub(r"\\item(?:\[[^\]\n]*\])?\s*", "- ", parts[k])
        p = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\]|\{[^{}]*\})*[ \t]*\n?", "", p)
        p = re.sub(r"\\(?:label|ref|cite|usepackage|documentclass)(?:\[[^\]\n]*\])?\{[^{}]*\}", "", p)
        for _ in range(3):
            p = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", p)
        parts[k] = re.sub(r"\\(?:maketitle|tableofcontents|noindent|hline|centering|newpage)\b[ \t]*", "", p)
    return "".join(parts)


def clean(text: str) -> str:
    """The text without its markup; headings as #, lists as -, code in fences and formulas between $ are kept."""
    found = kinds(text)
    if "html" in found:
        if re.search(rf"(?i)<(?:{TAGS})\b", text):
            text = html_to_text(text) if re.search(r"(?i)<(?:html|body|p|div|td|li|table|h[1-6]|ul)\b", text) else re.sub(rf"(?is)<!--.*?-->|<!\[[^>]*>|{_TAG}", "", re.sub(r"(?i)<br\b[^<>]*>", "\n", text))
        text = html.unescape(re.sub(r"(?is)<!--.*?-->|<!\[[^>]*>|\]-->", "", text)).replace("\xa0", " ")
    for kind, convert in (("latex", latex_to_text), ("wiki", wiki_to_text), ("markdown", markdown_to_text)):
        if kind in found:
            text = convert(text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, clean): every document without markup; null stays null."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "clean": pa.array([None if t is None else clean(t) for t in batch.column(1).to_pylist()], pa.string())}

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, "doc_id long, clean string")
