"""Languages of documents and of the passages of mixed ones, by cross parsing.

A suffix automaton of each language's labelled text gives, at every point of a sentence, the longest match
that the language has for what follows; the sentence is cut into these matches, and the language that needs
the fewest phrases for its length wins.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LETTERS = 26
SPACE, OTHER = 0, LETTERS + 1
SYMBOLS = LETTERS + 2
#: A lane parses this many symbols of a sentence at most; longer ones take several lanes.
LANE = 240
#: Characters of labelled text used of each language; more adds little and the table of transitions grows with it.
SAMPLE_CHARS = 60_000


def _fold_table() -> np.ndarray:
    """For each code point of the basic plane: a letter's number without its accents, OTHER for other letters, else SPACE."""
    table = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if not ch.isalpha():
            continue
        base = unicodedata.normalize("NFKD", ch)[0].lower()
        table[cp] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return table


FOLD = _fold_table()
UPPER = np.array([chr(cp).isupper() for cp in range(0x3000)])
DIGIT = np.array([chr(cp).isdigit() for cp in range(0x3000)])
#: Marks before a quoted line that name its writer.
INITIALS = re.compile(r"(?m)^[ \t]*[A-Z]{1,3}>+ ?")


def _symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 0x10000, FOLD[np.minimum(cp, 0xFFFF)], SPACE)


def _squeezed(symbols: np.ndarray) -> np.ndarray:
    return symbols[(symbols != SPACE) | (np.concatenate(([SPACE], symbols[:-1])) != SPACE)]


class SuffixAutomaton:
    """The least automaton of all substrings of a sequence of symbols."""

    def __init__(self, symbols: Iterable[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            new = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            elif self.length[q := self.next[p][c]] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(dict(self.next[q]), self.length[p] + 1)
                self.link[twin] = self.link[q]
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
            last = new

    def _state(self, following: dict[int, int], length: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def parser(self) -> np.ndarray:
        """Table (states x symbols) of 2 * next state + 1 if a phrase ends before the symbol."""
        n = len(self.next)
        table = np.zeros((n, SYMBOLS), np.int32)
        root = np.array([self.next[0].get(c, 0) for c in range(SYMBOLS)], np.int32)
        table[:] = 2 * root + 1
        for state, following in enumerate(self.next):
            for c, to in following.items():
                table[state, c] = 2 * to
        return table


class Model:
    """The parsers of all languages in one table."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        tables, self.roots, at = [], [], 0
        for lang in self.langs:
            text = _squeezed(np.concatenate([np.append(_symbols(t), SPACE) for t in samples[lang]] or [np.zeros(0, np.uint8)]))
            table = SuffixAutomaton(text.tolist()).parser()
            tables.append(table + 2 * at)
            self.roots.append(at)
            at += len(table)
        self.table = np.concatenate(tables or [np.zeros((0, SYMBOLS), np.int32)]).ravel()
        self.start = np.array(self.roots, np.int32)[:, None] * SYMBOLS

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """How many phrases each language needs (languages x lanes)."""
        order = np.argsort(-sizes, kind="stable")
        counts = np.zeros((len(self.langs), len(sizes)), np.int32)
        state = np.repeat(self.start, len(sizes), 1)
        where, left = starts[order], sizes[order]
        live = len(sizes)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left[:live], -step, side="left"))  # lanes longer than step
            c = symbols[where[:live] + step]
            to = self.table[state[:, :live] + c]
            counts[:, :live] += to & 1
            state[:, :live] = (to >> 1) * SYMBOLS
        out = np.empty_like(counts)
        out[:, order] = counts + 1
        return out


def sentences(texts: list[str]) -> dict[str, np.ndarray]:
    """All texts' sentences: squeezed symbols, and for each sentence its text, start, size, letters, and whether it is a whole sentence.

    A sentence ends at . ! ? before white space and an upper-case letter or the end of its paragraph; a
    paragraph at a line with no letter or digit. Only sentences with such an end count as whole.
    """
    joined = "\n\n".join(INITIALS.sub("", t) if ">" in t else t for t in texts) + "\n\n"
    lengths = np.fromiter((len(INITIALS.sub("", t)) if ">" in t else len(t) for t in texts), np.int64, len(texts)) + 2
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    symbols = np.where(cp < 0x10000, FOLD[np.minimum(cp, 0xFFFF)], SPACE)
    low = np.minimum(cp, 0x2FFF)
    alnum = (symbols != SPACE) | DIGIT[low]
    at = np.arange(n)
    following = np.minimum.accumulate(np.where(alnum, at, n)[::-1])[::-1]  # next letter or digit
    newline = np.cumsum(cp == 10)
    white = (cp == 32) | (cp == 10) | (cp == 13) | (cp == 9) | (cp == 0xA0)
    end = ((cp == 46) | (cp == 33) | (cp == 63) | (cp == 0x2026)) & np.append(white[1:], True)
    next_at = np.minimum(following, n - 1)
    lines = newline[next_at] - newline + (cp == 10)
    last = (following >= n) | (text_of[next_at] != text_of) | (lines >= 2)
    stop = end & (UPPER[low[next_at]] | last)
    para = (cp == 10) & (lines >= 2)  # no letter or digit on the line after this one
    cuts = stop | para
    unit = np.concatenate(([0], np.cumsum(cuts)[:-1]))
    unit_changes = np.concatenate(([True], (unit[1:] != unit[:-1]) | (text_of[1:] != text_of[:-1])))
    unit = np.cumsum(unit_changes) - 1
    units = int(unit[-1]) + 1 if n else 0
    first = np.flatnonzero(unit_changes)
    letters = np.bincount(unit, weights=symbols != SPACE, minlength=units).astype(np.int64)
    whole = np.bincount(unit, weights=stop, minlength=units) > 0
    keep = (symbols != SPACE) | (np.concatenate(([SPACE], symbols[:-1])) != SPACE) & ~unit_changes
    squeezed, unit_of = symbols[keep], unit[keep]
    sizes = np.bincount(unit_of, minlength=units)
    return {"symbols": squeezed, "text": text_of[first], "start": np.cumsum(sizes) - sizes, "size": sizes, "letters": letters, "whole": whole, "at": first - np.searchsorted(text_of, text_of[first])}


def classify(model: Model, s: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised phrases (languages x sentences)."""
    blocks = np.maximum(1, -(-s["size"] // LANE))
    lane_of = np.repeat(np.arange(len(blocks)), blocks)
    k = np.arange(len(lane_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = s["start"][lane_of] + k * LANE
    sizes = np.minimum(LANE, s["size"][lane_of] - k * LANE)
    phrases = model.phrases(s["symbols"], starts, sizes)
    return np.add.reduceat(phrases, np.cumsum(blocks) - blocks, axis=1) if len(blocks) else phrases


#: A sentence of fewer letters, or of a smaller lead over the second language, has no vote in a text that has clearer ones: greetings,
#: names and sign-offs would else make passages.
LEAST_LETTERS, LEAST_LEAD = 18, 0.12


def passages(model: Model, texts: list[str]) -> dict[str, np.ndarray]:
    """Runs of sentences in one language: text, language, confidence, letters, whole sentences, and the code point it starts at.

    Confidence is 1 - a / b for the phrases a of the language and b of the next best.
    """
    s = sentences(texts)
    p = classify(model, s)
    if not p.shape[1]:
        z = np.zeros(0, np.int64)
        return {"text": z, "lang": z, "confidence": z.astype(float), "letters": z, "whole": z, "start": z}
    ranked = np.sort(p, axis=0)
    lead = 1 - ranked[0] / np.maximum(1, ranked[1])
    sure = (s["letters"] >= LEAST_LETTERS) & (lead >= LEAST_LEAD)
    some = np.zeros(len(texts), bool)
    some[s["text"][sure]] = True
    # a text without any sure sentence is taken as one
    keep = np.flatnonzero(sure | (~some[s["text"]] & (s["letters"] > 0)))
    text, lang = s["text"][keep], np.argmin(p[:, keep], axis=0)
    unsure = ~some[text]
    lang = np.where(unsure, -1, lang)
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (lang[1:] != lang[:-1]))) if len(keep) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    if not len(first):
        z = np.zeros(0, np.int64)
        return {"text": z, "lang": z, "confidence": z.astype(float), "letters": z, "whole": z, "start": z}
    total = np.add.reduceat(p[:, keep], first, axis=1)
    best = np.argmin(total, axis=0)
    ranked = np.sort(total, axis=0)
    return {
        "text": text[first],
        "lang": best,
        "confidence": 1 - ranked[0] / np.maximum(1, ranked[1]),
        "letters": np.add.reduceat(s["letters"][keep], first),
        "whole": np.add.reduceat(s["whole"][keep].astype(np.int64), first),
        "start": s["at"][keep][first],
    }


def build(samples: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """The model of labelled rows (lang, sample_no, text); of each language at most sample_chars characters are used."""
    from pyspark.sql import Window

    rows = samples.where("lang is not null and length(text) > 0").withColumn("upto", F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("sample_no", "text").rowsBetween(Window.unboundedPreceding, 0)))
    found: dict[str, list[str]] = {}
    for lang, text in rows.where(F.col("upto") <= sample_chars).orderBy("lang", "sample_no", "text").select("lang", "text").collect():
        found.setdefault(lang, []).append(text)
    return Model(found)


SEGMENTS = "doc_id long, segment int, start int, lang string, confidence double, letters int, sentences int"


def segments(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, segment, start, lang, confidence, letters, sentences): each document's passages in order.

    Null ids, and texts without a letter, give no row; without samples there is no row at all. A text of which no sentence is long and clear enough is one segment.
    """
    sent = docs.sparkSession.sparkContext.broadcast(build(samples))
    if not sent.value.langs:
        return docs.sparkSession.createDataFrame([], SEGMENTS)

    def run(batch: pa.RecordBatch) -> dict:
        model = sent.value
        p = passages(model, batch.column(1).to_pylist())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        number = np.arange(len(p["text"])) - np.searchsorted(p["text"], p["text"])
        return {
            "doc_id": pa.array(ids[p["text"]], pa.int64()),
            "segment": pa.array(number, pa.int32()),
            "start": pa.array(p["start"], pa.int32()),
            "lang": pa.array(np.array(model.langs, object)[p["lang"]], pa.string()),
            "confidence": pa.array(p["confidence"], pa.float64()),
            "letters": pa.array(p["letters"], pa.int32()),
            "sentences": pa.array(p["whole"], pa.int32()),
        }

    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long"), F.col(text_col))
    return map_arrow(rows, run, SEGMENTS)


def usable(label) -> str:
    """A label's language code, without region and case; empty if it names none."""
    code = re.split(r"[-_]", (label or "").strip().lower())[0]
    return "" if code in ("", "und", "unknown") else code


#: Letters a text must have to be judged against its label, letters of a passage, and sentences that make one.
JUDGED_LETTERS, PASSAGE_LETTERS, PASSAGE_SENTENCES = 60, 40, 2


def mislabelled(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Rows (doc_id, lang): for each document with a missing or wrong label or several languages, each language of a passage in it.

    A language counts if a passage of two whole sentences is in it; if none does, the one with most letters does.
    Texts of fewer than 60 letters, null or empty ones, and null ids give no row; without samples there is no row at all.
    """
    sent = docs.sparkSession.sparkContext.broadcast(build(samples))
    if not sent.value.langs:
        return docs.sparkSession.createDataFrame([], "doc_id long, lang string")

    def run(batch: pa.RecordBatch) -> dict:
        model = sent.value
        ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
        p = passages(model, batch.column(1).to_pylist())
        n, k = len(labels), len(model.langs)
        letters = np.bincount(p["text"], p["letters"], n)
        mass = np.bincount(p["text"] * k + p["lang"], p["letters"], n * k).reshape(n, k)
        counts = (p["whole"] >= PASSAGE_SENTENCES) & (p["letters"] >= PASSAGE_LETTERS)
        has = np.bincount((p["text"] * k + p["lang"])[counts], minlength=n * k).reshape(n, k) > 0
        none = ~has.any(1)
        has[none, np.argmax(mass[none], axis=1)] = True
        code = {lang: i for i, lang in enumerate(model.langs)}
        said = np.array([code.get(usable(x), -1) for x in labels])
        right = (has.sum(1) == 1) & (said == np.argmax(has, axis=1))
        doc, lang = np.nonzero(has & (~right & (letters >= JUDGED_LETTERS))[:, None])
        return {"doc_id": pa.array(ids[doc], pa.int64()), "lang": pa.array(np.array(model.langs, object)[lang], pa.string())}

    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long"), F.col(text_col), F.col(label_col))
    return map_arrow(rows, run, "doc_id long, lang string").distinct()

