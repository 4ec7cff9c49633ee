"""Text that was decoded in a wrong charset: found by a classifier of encoding chains, and restored.

Labelled clean text is garbled by every chain of encodings; a multinomial model over hashed byte bigrams
learns to name the chain (and the language). A named chain is inverted, and the result counts only if every
step decodes strictly and the model takes the outcome for clean.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

BUCKETS = 1 << 14
SMOOTHING = 0.05
#: Log-likelihood by which a chain must beat every clean language, and what the model of arbitrary bytes needs.
LEAD, STRAY_LEAD = 1.5, 4.0
#: Lines whose letters are all in use in one language mostly are clean: of these, one is garbled only if the inversion of one of
#: its likeliest chains is so much likelier as clean text than the line is.
TRIED, GAIN = 4, 5.0
#: Lead by which plain letters tell a line's own language.
OWN_LEAD = 6.0
#: Bigrams that are scored at a time.
CHUNK = 1024
#: Rows of labelled text used of each language.
SAMPLE_ROWS = 400

#: Charsets in which text is misread. Fixed values.
READ_AS = ["latin-1", "cp1252", "cp1250", "iso8859-2", "iso8859-15", "mac-roman", "mac-latin2", "cp437", "cp850", "cp852", "cp1251", "koi8-r", "cp1254", "cp1257", "iso8859-16"]
TWICE = ["latin-1", "cp1252", "cp1250", "iso8859-2", "mac-roman"]
WRITTEN_IN = ["cp1252", "cp1250", "iso8859-2", "latin-1", "cp852", "cp850", "mac-roman", "iso8859-16", "iso8859-15"]
#: Marks that any of the languages may use; they stand in clean text of every language.
MARKS = "€ £ § ° º ª « » ‹ › “ ” „ ‘ ’ ‚ – — … • · ¿ ¡ © ® ™ ± × ½ ¼ ² ³ µ †"
#: Of these, the ones that a misread letter hardly ever turns into: a line with no others needs no closer look.
PLAIN_MARKS = set("€§°ºª«»“”„‘’–—…¿¡")
CAPITAL = np.array([cp > 127 and chr(cp).isupper() for cp in range(0x3000)])
BETWEEN = np.array([chr(cp) in PLAIN_MARKS - set("’‘–—…") for cp in range(0x3000)])
ODD = re.compile("[a-z](?:[" + "".join(chr(c) for c in np.flatnonzero(CAPITAL[:0x250])) + "]|[€§°ºª«»“”„¿¡][a-z])")
#: Controls and the mark of lost letters, which no written text holds.
BROKEN = re.compile("[\x80-\x9f\ufffd]")
#: Letters beyond a-z of each language's spelling. Fixed values.
SPELLING = {"hu": "áéíóöőúüű", "en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "ro": "ăâîșțşţ"}
LINES = [f"x {m} y 1{m} {m}x x{m} {m} ({m})" for m in MARKS.split()] + ["we’ll can’t hasn’t we’d don’t I’m", " ".join(f"{c}’{v}" for c in "cdjlmnstu" for v in "aeiouyh"), "120 €, 45 €; 12 €.", "n.º 12 1.ª"]


def _sloppy(name: str) -> str:
    """The characters of a single-byte charset in order; undefined bytes stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars)


_CHARS = {name: _sloppy(name) for name in {*READ_AS, *TWICE, *WRITTEN_IN}}
_BYTES = {name: codecs.charmap_build(chars) for name, chars in _CHARS.items()}


def encode(text: str, charset: str, errors: str = "strict") -> bytes | None:
    """None if the charset lacks a character; errors as for codecs."""
    if charset == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    try:
        return codecs.charmap_encode(text, errors, _BYTES[charset])[0]
    except UnicodeEncodeError:
        return None


def decode(data: bytes, charset: str) -> str | None:
    if charset == "utf-8":
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None
    return codecs.charmap_decode(data, "strict", _CHARS[charset])[0]


@dataclass(frozen=True)
class Chain:
    """What happened to a text: pairs (written in, read as), first to last; lossy if letters are gone for good."""

    steps: tuple[tuple[str, str], ...]
    lossy: bool = False

    @property
    def name(self) -> str:
        return " ".join(f"{a}>{b}" for a, b in self.steps)

    def garble(self, text: str) -> str | None:
        for written, read in self.steps:
            if self.lossy:
                text = encode(text, written, "replace").decode("utf-8", "replace")
                continue
            text = decode(encode(text, written, "ignore"), read)  # what the charset lacks is left out
        return text

    def restore(self, text: str) -> str | None:
        if self.lossy:
            return None
        for written, read in reversed(self.steps):
            data = encode(text, read)
            text = None if data is None else decode(data, written)
            if text is None:
                return None
        return text


def chains() -> list[Chain]:
    out = [Chain((("utf-8", r),)) for r in READ_AS]
    out += [Chain((("utf-8", a), ("utf-8", b))) for a in TWICE for b in TWICE]
    out += [Chain(((w, r),)) for w in WRITTEN_IN for r in READ_AS if w != r]
    out += [Chain(((w, "utf-8"),), lossy=True) for w in WRITTEN_IN]
    return out


def bigrams(text: str) -> np.ndarray:
    """Hashed pairs of UTF-8 bytes of which one at least is not ASCII."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    pair = (b[:-1] << 8) | b[1:]
    pair = pair[(pair & 0x8080) != 0]
    return (pair * np.uint32(40503) >> np.uint32(2)) & np.uint32(BUCKETS - 1)


def _plain(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the pairs of plain letters or blanks among code points."""
    low = cp | 32
    letter = np.where((low >= 97) & (low <= 122), low - 96, np.where(cp == 32, 0, 31)).astype(np.int64)
    at = np.flatnonzero((letter[:-1] < 31) & (letter[1:] < 31))
    return at, letter[at] * 32 + letter[at + 1]


class Model:
    """Multinomial naive Bayes over (chain, language), clean text of each language and of all, and arbitrary bytes."""

    def __init__(self, samples: dict[str, list[str]]):
        self.chains = chains()
        langs = sorted(samples)
        self.langs = len(langs)
        # every letter of a language's spelling beside every other letter, for words that the samples lack
        spelt = {lang: ["".join(f"{x}{c}" for x in "abcdefghijklmnopqrstuvwxyz ") + c for c in SPELLING.get(lang, "")] for lang in langs}
        spelt = {lang: [*lines, *("".join(f" {c}{x}" for x in "abcdefghijklmnopqrstuvwxyz.") for c in SPELLING.get(lang, "").upper())] for lang, lines in spelt.items()}
        clean = {lang: [*samples[lang], *(t.upper() for t in samples[lang]), *spelt[lang], *LINES] for lang in langs}
        rows = [self._counts(clean[lang]) for lang in langs]
        rows.append(sum(rows, np.zeros(BUCKETS, np.int64)))
        kind, spoken = [-1] * len(rows), [*range(len(langs)), -1]
        for i, chain in enumerate(self.chains):
            for at, lang in enumerate(langs):
                # the same lines as for the clean language, changed or not, so that only what a chain changes tells them apart
                garbled = [chain.garble(t) for t in clean[lang]]
                if garbled != clean[lang]:
                    counts = self._counts(garbled)
                    rows.append(counts)
                    kind.append(i)
                    spoken.append(at)
        self.counts, self.kind, self.spoken = np.array(rows, np.uint32), np.array(kind), np.array(spoken)
        self._weigh()
        plain = np.array([np.bincount(_plain(np.frombuffer("\n".join(samples[lang]).encode("utf-32-le", "surrogatepass"), np.uint32))[1], minlength=1 << 10) for lang in langs] or [np.zeros(1 << 10)], np.float32)
        self.plain = np.log((plain + 0.5) / (plain.sum(1, keepdims=True) + 512)).T.astype(np.float32)
        self.stray = -np.log(BUCKETS)
        # languages in whose clean text a letter occurs, as bits
        self.known = np.zeros(0x3000, np.uint8)
        for bit, lang in enumerate(langs):
            for c in {c for t in clean[lang] for x in (t, t.upper(), t.lower()) for c in x}:
                if ord(c) < 0x3000 and (c.isalpha() or c in PLAIN_MARKS):
                    self.known[ord(c)] |= 1 << bit

    def _weigh(self) -> None:
        """Logarithms by bucket: of clean text in each language and in all, and, language by language, of garbled text."""
        counts = self.counts.astype(np.float32)
        logs = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
        self.clean = logs[self.kind < 0].T.copy()
        which = [np.flatnonzero((self.kind >= 0) & (self.spoken == lang)) for lang in range(self.langs)]
        self.garbled, self.chain_of = [logs[w].T.copy() for w in which], [self.kind[w] for w in which]

    def __getstate__(self) -> dict:
        """Only the counts that are not zero travel; weights are made where they arrive."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("counts", "clean", "garbled", "chain_of")}
        at = np.flatnonzero(self.counts)
        return state | {"sparse": (self.counts.shape, at.astype(np.uint32), self.counts.ravel()[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, values = state.pop("sparse")
        self.__dict__.update(state)
        self.counts = np.zeros(shape, np.uint32)
        self.counts.ravel()[at] = values
        self._weigh()

    @staticmethod
    def _counts(texts: list[str]) -> np.ndarray:
        return np.bincount(bigrams("\n".join(texts)), minlength=BUCKETS)

    def _scores(self, lines: list[str], own: np.ndarray, garbled: bool = True):
        """Numbers of lines, their bigrams, and their scores: of clean text, and of garbled text with its chains. Some lines at a time.

        A line whose language is known is scored as that language's garbled text only.
        """
        data = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        pair = (data[:-1] << 8) | data[1:]
        some = np.flatnonzero(((pair & 0x8080) != 0) & (data[:-1] != 10) & (data[1:] != 10))
        line = np.cumsum(data == 10)[some]
        bucket = (pair[some] * np.uint32(40503) >> np.uint32(2)) & np.uint32(BUCKETS - 1)
        order = np.argsort(own[line], kind="stable")
        line, bucket = line[order], bucket[order]
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(line)))
        turns = np.cumsum(size) // CHUNK + (own[line[first]] << 40)
        for turn in np.split(np.arange(len(first)), np.flatnonzero(np.diff(turns)) + 1) if len(first) else []:
            a, b = first[turn[0]], first[turn[-1]] + size[turn[-1]]
            lang, total = own[line[first[turn[0]]]], lambda w, a=a, b=b, at=first[turn]: np.add.reduceat(w[bucket[a:b]], at - a, axis=0)
            spoken = range(self.langs) if lang < 0 else [lang]
            scores = [total(self.garbled[k]) for k in spoken] if garbled else []
            yield line[first[turn]], size[turn], total(self.clean), np.concatenate(scores, 1) if scores else None, np.concatenate([self.chain_of[k] for k in spoken])

    def judge(self, lines: list[str], explained: np.ndarray, own: np.ndarray | None = None) -> list[list[Chain] | None]:
        """Of each line the chains that may have garbled it, likeliest first; None if it is clean. own is the language each is in, or -1."""
        out: list[list[Chain] | None] = [None] * len(lines)
        if not self.langs:  # without samples nothing is judged
            return out
        own = np.full(len(lines), -1) if own is None else own
        broken = np.array([bool(BROKEN.search(x)) for x in lines], bool)
        asked: list[tuple[int, Chain, str, float, float]] = []
        for number, size, clean_scores, score, chain_of in self._scores(lines, own):
            clean, best = clean_scores.max(1), score.max(1)
            sure = broken[number] | (~explained[number] & ((best > clean + LEAD) | (self.stray * size > clean + STRAY_LEAD)))
            for k in np.flatnonzero(sure | (best > clean + LEAD)):
                n = int(number[k])
                at = np.arange(len(chain_of)) if sure[k] else np.argpartition(-score[k], min(3 * TRIED, len(chain_of) - 1))[: 3 * TRIED]
                likely = [self.chains[c] for c in dict.fromkeys(chain_of[at[np.argsort(-score[k][at])]].tolist())]
                if sure[k]:
                    out[n] = likely
                    continue
                mine = clean_scores[k, own[n]] if own[n] >= 0 else clean[k]
                # what a chain leaves as it is says nothing about it
                asked += [(n, c, r, float(clean[k]), float(mine)) for c in likely[:TRIED] if (r := c.restore(lines[n])) is not None and r != lines[n] and self.explains(r)]
        if asked:
            gained = np.array([a[2].isascii() for a in asked])
            for number, _, scores, _, _ in self._scores([a[2] for a in asked], np.array([own[a[0]] for a in asked]), False):
                for k, row in zip(number.tolist(), scores, strict=True):
                    n, _, _, clean, mine = asked[k]
                    after = row.max()
                    gained[k] = after > clean + GAIN and (row[own[n]] if own[n] >= 0 else after) > mine + GAIN
            for ok, (n, chain, _, _, _) in zip(gained, asked, strict=True):
                if ok:
                    out[n] = [*(out[n] or []), chain]
        return out

    def is_clean(self, text: str) -> bool:
        return self.judge([text.replace("\n", " ")], np.array([self.explains(text)]))[0] is None

    def explains(self, text: str) -> bool:
        """Whether all characters occur in the clean text of one language."""
        if ODD.search(text):
            return False
        bits = 255
        for c in text:
            if c > "\x7f":
                bits &= int(self.known[ord(c)]) if ord(c) < 0x3000 else 0
        return bits > 0

    def restore(self, line: str, likely: list[Chain]) -> tuple[str | None, str | None]:
        """The original line and the chain's name, if an inversion decodes strictly and gives clean text."""
        for chain in likely:
            text = chain.restore(line)
            if text is not None and text != line and self.is_clean(text):
                return text, chain.name
        return None, None

    def accented(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Lines with a character beyond ASCII: number of the text, start and end in it, whether one language explains all its letters, and its own language or -1."""
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        ends = np.flatnonzero(cp == 10)
        high = np.flatnonzero(cp > 127)
        if not len(high):
            z = np.zeros(0, np.int64)
            return z, z, z, z.astype(bool), z
        line = np.searchsorted(ends, high)
        bits = np.where(cp[high] < 0x3000, self.known[np.minimum(cp[high], 0x2FFF)], 0)
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        # capitals behind small letters, and marks between letters, are what misread letters look like
        before, after = cp[np.maximum(high - 1, 0)], cp[np.minimum(high + 1, len(cp) - 1)]
        inside = (before >= 97) & (before <= 122)
        low = np.minimum(cp[high], 0x2FFF)
        bits[inside & (CAPITAL[low] | (BETWEEN[low] & (after >= 97) & (after <= 122)))] = 0
        explained = np.bitwise_and.reduceat(bits, first) > 0
        line = line[first]
        begin = np.where(line > 0, ends[line - 1] + 1, 0)
        text = np.searchsorted(starts, begin, side="right") - 1
        own = np.full(len(line), -1)
        if self.langs > 1:
            at, kind = _plain(cp)
            of = np.searchsorted(ends, at)
            some = np.isin(of, line)
            of, kind = of[some], kind[some]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
            score = np.add.reduceat(self.plain[kind], first, axis=0) if len(first) else np.zeros((0, self.langs))
            ranked = np.sort(score, axis=1)
            own[np.searchsorted(line, of[first])] = np.where(ranked[:, -1] - ranked[:, -2] >= OWN_LEAD, score.argmax(1), -1)
        return text, begin - starts[text], ends[line] - starts[text], explained, own


def sent_model(samples: DataFrame | Broadcast) -> Broadcast:
    """The trained model for all executors; a model that has been sent already is used again."""
    return samples if isinstance(samples, Broadcast) else samples.sparkSession.sparkContext.broadcast(build(samples))


def build(samples: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on labelled rows (lang, sample_no, text), of each language the first sample_rows."""
    from pyspark.sql import Window

    rows = samples.where("lang is not null and length(text) > 0").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("sample_no", "text")))
    found: dict[str, list[str]] = {}
    for lang, text in rows.where(F.col("k") <= sample_rows).orderBy("lang", "k").select("lang", "text").collect():
        found.setdefault(lang, []).append(text)
    return Model(found)


def repair(model: Model, texts: list[str], thorough: bool = True) -> list[tuple[int, str | None, str, bool]]:
    """For each garbled text: its number, the text with every line restored that can be, the chains, and whether all lines were.

    Unless thorough, lines whose letters are all in use in one language are taken for clean.
    """
    number, start, end, explained, own = model.accented(texts)
    if not thorough:
        number, start, end, own, explained = (x[~explained] for x in (number, start, end, own, explained))
    spans = list(zip(number.tolist(), start.tolist(), end.tolist(), strict=True))
    # greetings and the like stand in many texts; each different line is judged once
    different = {texts[n][a:b]: k for k, (n, a, b) in enumerate(spans)}
    at = np.fromiter(different.values(), np.int64, len(different))
    verdict = dict(zip(different, model.judge(list(different), explained[at], own[at]), strict=True))
    fixed: dict[str, tuple[str | None, str | None]] = {}
    hits: dict[int, list[tuple[int, int]]] = {}
    for n, a, b in spans:
        line = texts[n][a:b]
        if verdict[line] is not None:
            hits.setdefault(n, []).append((a, b))
            if line not in fixed:
                fixed[line] = model.restore(line, verdict[line])
    out: list[tuple[int, str | None, str, bool]] = []
    for n, places in hits.items():
        text, parts, at, names, whole = texts[n], [], 0, [], True
        for a, b in places:
            line, name = fixed[text[a:b]]
            parts += [text[at:a], text[a:b] if line is None else line]
            at = b
            whole &= line is not None
            names += [name] if name and name not in names else []
        out.append((n, "".join([*parts, text[at:]]), ", ".join(names), whole))
    return out


def readable(model: Model, texts: list[str]) -> list[str]:
    """Garbled texts restored where that keeps their lines, for operators that look for words: a line that could as well be clean stays."""
    out = list(texts)
    for number, fixed, _, _ in repair(model, texts, False):
        if fixed is not None and fixed.count("\n") == texts[number].count("\n"):
            out[number] = fixed
    return out


def declared(charset: str | None) -> str:
    """The charset a payload is read in: null is utf-8, blank iso-8859-2, an unknown name utf-8."""
    if charset is None:
        return "utf-8"
    name = charset.strip().strip("\"'")
    if not name:
        return "iso8859-2"
    try:
        info = codecs.lookup(name)
    except (LookupError, ValueError):
        return "utf-8"
    return info.name if info._is_text_encoding else "utf-8"


_OUT = "tbl string, row_id long, part_no int, restored string, chain string, whole boolean"


def garbled_documents(docs: DataFrame, samples: DataFrame | Broadcast, id_col: str = "doc_id", text_col: str = "text", tbl: str = "documents", texts_too: bool = True) -> DataFrame:
    """Rows (tbl, row_id, part_no, restored, chain, whole) of the records that hold wrongly decoded letters.

    restored is the text with each garbled line replaced where an inversion succeeds; whole tells whether all
    were. Null ids and null, empty or ASCII texts give no row. Without texts_too restored is null.
    """
    sent = sent_model(samples)

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_pylist()
        found = repair(sent.value, batch.column(1).to_pylist())
        return _columns([(tbl, ids[n], 0, fixed if texts_too else None, names, whole) for n, fixed, names, whole in found])

    # only texts with a letter beyond ASCII can hold such letters
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x00-\x7F]")).select(F.col(id_col).cast("long"), F.col(text_col))
    return map_arrow(rows, run, _OUT)


def garbled_parts(parts: DataFrame, samples: DataFrame | Broadcast, texts_too: bool = True) -> DataFrame:
    """The same for the text parts (msg_no, part_no, ctype, charset, payload) of messages, read in their declared charsets.

    A payload that its charset cannot decode is garbled; then the first of UTF-8, the legacy charsets of the
    model that decodes strictly to clean text gives the restored text. Parts that are not text, and null or
    empty payloads, give no row.
    """
    sent = sent_model(samples)

    def run(batch: pa.RecordBatch) -> dict:
        model, out, texts, keys = sent.value, [], [], []
        for msg, part, charset, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            name = declared(charset)
            try:
                texts.append(payload.decode(name))
                keys.append((msg, part, name, payload))
            except (UnicodeDecodeError, UnicodeError):
                fixed = next(((t, f"read as {c}") for c in ("utf-8", *WRITTEN_IN) if (t := decode(payload, c)) is not None and model.is_clean(t)), (None, ""))
                out.append(("mime_parts", msg, part, fixed[0] if texts_too else None, fixed[1], fixed[0] is not None))
        for n, text, names, whole in repair(model, texts):
            out.append(("mime_parts", *keys[n][:2], text if texts_too else None, names, whole))
        return _columns(out)

    rows = parts.where(F.lower(F.trim("ctype")).startswith("text/") & F.col("msg_no").isNotNull() & (F.length("payload") > 0)).select(F.col("msg_no").cast("long"), F.col("part_no").cast("int"), "charset", "payload")
    return map_arrow(rows, run, _OUT)


def _columns(rows: list[tuple]) -> dict:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
    names = ("tbl", "row_id", "part_no", "restored", "chain", "whole")
    return {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))}
