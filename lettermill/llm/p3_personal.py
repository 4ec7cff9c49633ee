"""Personal information in free text: found by bootstrapped contextual extraction, and replaced by typed placeholders.

E-mail addresses, phone numbers and street addresses have forms of their own. Names and identity numbers are
told by their company: seed entities (a partial list of names; numbers behind words such as passport) induce
patterns, Spark scores patterns by their instances and instances by their patterns in turn, and what scores
high enough joins the lexicon by which all occurrences are found.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hinted, map_arrow
from .p5_encoding import readable, sent_model

#: Rounds of scoring; scores from which words and contexts are accepted; times that a word must stand beside a name, and
#: the share of all the texts with it, capitalised, that these must be.
ROUNDS, WORD_SCORE, NUMBER_SCORE, LEAST_SEEN, LEAST_SHARE = 4, 0.35, 0.7, 3, 0.4

FOLD = {cp: unicodedata.normalize("NFKD", chr(cp))[0].lower() for cp in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(cp))[0].isascii()} | {0xDF: "s", 0x2019: "'"}
_FOLDED = re.compile("[À-ɏ’]")
#: What a line break and the quote marks behind it are turned into blanks by, so that places stay the same.
BREAK = re.compile(r"\r?\n[ \t]*(?:(?:[A-Z]{1,3})?>[> \t]*|[|:](?=[ \t]))?")

EMAIL = re.compile(r"[\w.+-]+(?:@| +@ +| *[(\[]at[)\]] *)[\w-]+(?:(?:\.| +\. +| *[(\[]dot[)\]] *)[a-zA-Z][\w-]*)+")
PHONE = re.compile(
    r"(?<![\w.])\+\d{1,3}(?:(?: +|[.-])\d{2,7}){2,5}(?![\d-])"
    r"|(?<![\d.-])00\d{2}(?:\.\d{2,3}){3,5}(?![\d.]\d)|(?<![\d.-])00\d{2} +\d{3} +\d{3,4}(?: *ext\.? *\d+)?(?![\d-])"
    r"|(?<![\d/-])\d{2}-\d{2}/\d{3}-\d{4}(?![\d-])|\(\d{2,4}\) *\d{3} +\d{3,4}(?![\d-])|(?<![\w/.-])\d{3}-\d{4}(?![\w/-])"
)
_NO = r"[\d#]+(?: ?/? ?[a-z](?!\w))?(?!\w)"
#: Words for streets before or behind their name, by the order of name and number. Fixed values.
ADDRESS = re.compile(
    rf"\b\w+ +(?:utca|ut|koz|ter|fasor|setany|korut|krt\.?|rakpart|dulo) +{_NO}"
    rf"|(?<![\w#]){_NO} +\w+ +(?:street|road|lane|avenue|close|drive|court|crescent|terrace)\b"
    rf"|\b\w{{3,}}(?:strasse|strase|stras|weg|gasse|allee|platz|ufer|ring|graben|damm|steig|markt|pfad|hof|berg) +{_NO}"
    rf"|(?<![\w#])[\d#]+(?: +bis| +ter)? *,? +(?:rue|allee|impasse|avenue|boulevard|chemin|place|quai|cours|square) +(?!de\b|du\b|des\b|d')\w+"
    rf"|\b(?:calle|avenida|plaza|paseo|camino|travesia|ronda|glorieta) +\w+ *,? +{_NO}"
    rf"|\b(?:strada|aleea|bulevardul|calea|piata|soseaua|splaiul|intrarea) +\w+ *,? +(?:nr *\.? *)?{_NO}"
)
#: The words of these patterns, _ for a blank; house numbers; the marks of addresses.
STREETS = "utca ut_ koz_ ter_ fasor setany korut krt rakpart dulo street road lane avenue close drive court crescent terrace strasse strase stras weg_ gasse allee platz_ ufer_ ring_ graben_ damm_ steig_ markt_ pfad_ hof_ berg_ rue_ impasse boulevard chemin place quai cours square calle avenida plaza paseo camino travesia ronda glorieta strada aleea bulevardul calea piata soseaua splaiul intrarea"
HOUSE = re.compile(r"[\d#]")
AT = re.compile(r"@|[(\[]at[)\]]")
#: Where a phone number can start: enough digits, with what may stand between them.
DIGITS = re.compile(r"(?:\+|\(|(?<!\w))\d[\d .()/-]{6,}")
#: Words that name a number given to a person. Fixed values.
TRIGGERS = (
    r"identity card|\bid card|passport|\btax id|tax number|social security|national insurance"
    r"|adoazonosito|adoszam|\btaj\b|szemelyi ig|szemelyi szam|utlevel"
    r"|ausweis|reisepas|steuer-?id|steuernummer|steueridentif|sozialversicherung"
    r"|carte d'identite|passeport|fiscal|securite sociale"
    r"|de identidad|\bdni\b|\bnie\b|pasaporte|seguridad social"
    r"|de identitate|pasaport|numeric personal|\bcnp\b|asigurari|asigurare"
)
TRIGGER = re.compile(TRIGGERS)
#: The pattern of every number behind such a word.
TRIGGERED = "!"
NUMBER = re.compile(r"(?<![\w.,/+-])(?:[A-Z]{1,2} ?|[a-z]{1,2}(?=\d))?\d[\d-]*(?: +\d[\d-]*){0,3}(?:[A-Za-z]{2})?(?![\w/]|[.,]\d)")
_WORDS_BEFORE = re.compile(r"[^\W\d_][\w'-]*")

_WORD = re.compile(r"[^\W\d_][\w'-]+|[^\W\d_]\.")
_UP = "A-ZÀ-ÖØ-ÞĂŐŰŒȘȚŞŢŚŠŽČ"
#: One to four words with a capital, with blanks or "Family, Given" commas between them; initials may stand among them.
UNIT = re.compile(rf"(?<![\w@.+-])(?:[{_UP}]\. ?)?[{_UP}][\w'-]+(?:,? (?:[{_UP}]\. ?)?[{_UP}][\w'-]+){{0,3}}(?![\w@])|(?<![\w@.+-])[{_UP}]\. ?[{_UP}][\w'-]+(?![\w@])")


def flatten(text: str) -> str:
    """The text in one line, each break and quote mark a blank; every place stays the same."""
    return BREAK.sub(lambda m: " " * len(m[0]), text) if "\n" in text else text


def fold(text: str) -> str:
    """Lower case without accents, of the same length."""
    # accented letters are few: they are replaced one by one, and the rest is lowered at once
    return text.lower() if text.isascii() else _FOLDED.sub(lambda m: FOLD.get(ord(m[0]), m[0]), text).lower()


def _around(pattern: re.Pattern, text: str, places: Iterable[tuple[int, int]], left: int, right: int) -> set[tuple[int, int]]:
    """Matches of a pattern in the text around some places only; a window starts and ends at a blank, so that no word is cut."""
    out: set[tuple[int, int]] = set()
    reached = -1
    for a, b in places:
        if b <= reached:
            continue
        start = max(0, text.rfind(" ", 0, max(0, a - left)))
        end = text.find(" ", b + right)
        for m in pattern.finditer(text, start, len(text) if end < 0 else end):
            out.add(m.span())
            reached = max(reached, m.end())
    return out


def forms(flat: str, low: str) -> list[tuple[str, int, int]]:
    """Occurrences (kind, start, end) that their form tells: e-mail, phone, address."""
    out = []
    if "@" in flat or "at)" in low or "at]" in low:
        out += [("email", *span) for span in _around(EMAIL, flat, (m.span() for m in AT.finditer(flat)), 64, 96)]
    out += [("phone", *span) for span in _around(PHONE, flat, (m.span() for m in DIGITS.finditer(flat)), 0, 16)]
    streets = ((end - 3, end + 1) for end, _ in _streets().iter(low) if HOUSE.search(low, max(0, end - 40), end + 40))
    out += [("address", *span) for span in _around(ADDRESS, low, streets, 48, 48)]
    return out


@cache
def _streets() -> ahocorasick.Automaton:
    """All street words in one automaton."""
    found = ahocorasick.Automaton()
    for word in STREETS.split():
        word = word.replace("_", " ")
        found.add_word(word, word)
    found.make_automaton()
    return found


def _shape(number: str) -> str:
    return re.sub(r"[a-z]", "a", re.sub(r"\d", "9", number.lower()))


def numbers(flat: str, low: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int]]:
    """Long numbers that nothing else accounts for: shape, the words before, start, end."""
    out = []
    for m in NUMBER.finditer(flat):
        start, end = m.span()
        if sum(c.isdigit() for c in m[0]) < 6 or any(a < end and start < b for _, a, b in taken):
            continue
        before = re.split(r"[!?;,]|\d{2,}|\.(?= +\w{3})", low[max(0, start - 48) : start])[-1]
        context = " ".join(_WORDS_BEFORE.findall(before)[-4:])
        out.append((_shape(m[0]), context, start, end))
    return out


def units(text: str, taken: list[tuple[str, int, int]], names: frozenset[str] = frozenset()) -> list[tuple[list[tuple[str, int, int]], str, str, bool]]:
    """Groups of capitalised words of one line: the words with their places, the word before, the mark behind, and whether a sentence starts there.

    The first of several words before an exclamation mark, comma or colon is a greeting's, unless it is among the names or stands behind a label.
    """
    flat = text
    for kind, a, b in taken:
        if kind == "email":
            flat = flat[:a] + "@" * (b - a) + flat[b:]
    out = []
    for m in UNIT.finditer(flat):
        words = [(w[0], m.start() + w.start(), m.start() + w.end()) for w in _WORD.finditer(m[0])]
        if len(words) > 1 and m[0].isupper() and not any(w[0][-1] == "." for w in words):
            continue  # a line in capitals tells nothing
        before = flat[max(0, m.start() - 24) : m.start()].rsplit("\n", 1)[-1].rstrip()
        behind = flat[m.end() : m.end() + 2].strip()[:1]
        opens = not before or before[-1] in ".!?¡>:|/"
        label = before[-1:] == ":" and before[-2:-1].isalpha()
        if opens and not label and len(words) > 1 and behind in ("!", ",", ":") and fold(words[0][0]) not in names:
            before, words = words[0][0], words[1:]  # the word of a greeting
        out.append((words, (_WORDS_BEFORE.findall(before) or [before[-1:] or "^"])[-1], behind, opens))
    return out


def candidates(texts: DataFrame, model: Broadcast | None = None) -> DataFrame:
    """Rows (row_id, kind, token, pattern, n) of texts (row_id, text).

    Kinds told by form have neither token nor pattern; numbers and capitalised words have a row for each pattern.
    Rows of kind seen count the texts of a batch that hold a capitalised word, whatever its company. With a model of
    encodings, garbled texts are read as restored.
    """

    def run(batch: pa.RecordBatch) -> dict:
        ids, kinds, tokens, patterns, counts, seen = [], [], [], [], [], Counter()
        read = batch.column(1).to_pylist()
        if model is not None:
            read = readable(model.value, read)
        for row, text in zip(batch.column(0).to_pylist(), read, strict=True):
            flat = flatten(text)
            low = fold(flat)
            taken = forms(flat, low)
            found = {(kind, None, None) for kind, _, _ in taken}
            for shape, context, _, _ in numbers(flat, low, taken):
                known = TRIGGER.search(context)
                found.add(("id_number", shape, TRIGGERED if known else " ".join(context.split()[-2:])))
                if known:
                    found.add(("id_number", None, None))
            mine: set[str] = set()
            for words, before, behind, opens in units(text, taken):
                mine.update(fold(w) for w, _, _ in words)
                if before[0].isupper():  # also the word that was taken for a greeting
                    mine.add(fold(before))
                if len(words) == 1:
                    if not opens or behind in "!,:" or not behind:
                        found.add(("name", fold(words[0][0]), "before " + fold(before)))
                    continue
                plain = [fold(w) for w, _, _ in words]
                for k, word in enumerate(plain):
                    if word[-1] == ".":
                        continue
                    for other in plain[max(0, k - 1) : k] + plain[k + 1 : k + 2]:
                        found.add(("name", word, "beside " + ("x." if other[-1] == "." else other)))
            seen.update(mine)
            for kind, token, pattern in found:
                ids.append(row)
                kinds.append(kind)
                tokens.append(token)
                patterns.append(pattern)
                counts.append(1)
        for token, n in seen.items():
            ids.append(None)
            kinds.append("seen")
            tokens.append(token)
            patterns.append("")
            counts.append(n)
        return {"row_id": pa.array(ids, pa.int64()), "kind": pa.array(kinds, pa.string()), "token": pa.array(tokens, pa.string()), "pattern": pa.array(patterns, pa.string()), "n": pa.array(counts, pa.int32())}

    return map_arrow(texts, run, "row_id long, kind string, token string, pattern string, n int")


def name_lexicon(found: DataFrame, names: DataFrame, seeds: DataFrame) -> DataFrame:
    """Words (token) that are names: the listed ones and those that keep their company."""
    edges = cut(found.where("kind = 'name' and pattern like 'beside %'").groupBy("token", "pattern").agg(F.count("*").alias("n")))
    seen = found.where("kind = 'seen'").groupBy("token").agg(F.sum("n").alias("seen"))
    score = scored_by_company(edges, seeds).where((F.col("score") >= WORD_SCORE) & (F.col("n") >= LEAST_SEEN))
    good = score.join(seen, "token").where((F.col("n") >= LEAST_SHARE * F.col("seen")) & (F.length("token") > 3))
    return good.select("token").unionByName(seeds).distinct()


def scored_by_company(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (token, score, n): patterns and instances score each other in turn.

    A pattern is "beside <word>", and its score is that word's own as an instance; an instance's score is the mean
    over its patterns. Seeds keep 1, an initial such as "K." 0.8. Only what is linked to a seed takes part in a join.
    """
    totals = cut(edges.groupBy("token").agg(F.sum("n").alias("n")))
    pairs = edges.select("token", F.substring("pattern", 8, 1000).alias("other"), "n")
    ones = seeds.select("token", F.lit(1.0).alias("s")).unionByName(edges.sparkSession.createDataFrame([("x.", 0.8)], "token string, s double"))
    score = ones
    for _ in range(rounds):
        spread = pairs.join(score.select(F.col("token").alias("other"), "s"), "other").groupBy("token").agg(F.sum(F.col("n") * F.col("s")).alias("m")).join(totals, "token").select("token", (F.col("m") / (F.col("n") + 0.5)).alias("s"))
        score = cut(spread.join(ones.select("token", F.col("s").alias("one")), "token", "full").select("token", F.coalesce("one", "s").alias("s")).where("s >= 0.05"))
    return score.join(totals, "token", "left").select("token", F.col("s").alias("score"), F.coalesce("n", F.lit(0)).alias("n"))


def number_contexts(found: DataFrame) -> DataFrame:
    """Contexts (pattern) without a trigger whose numbers mostly have shapes that only triggers precede."""
    edges = found.where("kind = 'id_number' and token is not null").groupBy("token", "pattern").agg(F.count("*").alias("n"))
    shapes = edges.groupBy("token").agg((F.sum(F.when(F.col("pattern") == TRIGGERED, F.col("n")).otherwise(0)) / (F.sum("n") + 1)).alias("s"))
    others = edges.where(F.col("pattern") != TRIGGERED).join(shapes, "token").groupBy("pattern").agg((F.sum(F.col("n") * F.col("s")) / (F.sum("n") + 1)).alias("p"), F.count("*").alias("shapes"), F.sum("n").alias("n"))
    return others.where((F.col("p") >= NUMBER_SCORE) & (F.col("shapes") >= 3) & (F.col("n") >= 8)).select("pattern")


def _seeds(names: DataFrame) -> DataFrame:
    src = "".join(chr(c) for c in FOLD)
    dst = "".join(FOLD.values())
    return names.where("name is not null and length(trim(name)) > 1").select(F.lower(F.translate(F.trim("name"), src, dst)).alias("token")).distinct()


def analysed(docs: DataFrame, log: DataFrame, names: DataFrame, samples: DataFrame | Broadcast | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates of documents (row_id, text) and log lines (row_id, tokens), the lexicon of names, the contexts of numbers, and the log's own words."""
    found = cut(candidates(docs, None if samples is None else sent_model(samples)))
    lines = log.select("row_id", F.array_join("tokens", " ").alias("text"))
    logged = cut(candidates(lines.where(F.col("text").rlike(r"[0-9#@(\[]"))).where("kind <> 'name'"))
    lexicon = cut(name_lexicon(found, names, _seeds(names)))
    contexts = cut(number_contexts(found.unionByName(logged)))
    return found, logged, lexicon, contexts, log


def personal(docs: DataFrame, log: DataFrame, names: DataFrame, samples: DataFrame | Broadcast | None = None) -> DataFrame:
    """Rows (tbl, row_id, kind): the kinds of personal information in each document (row_id, text) and log line (row_id, tokens).

    Null ids, null or empty texts and null token lists give no row; null tokens are skipped; repeated rows give
    one. names has the known names (name); with samples of clean
    text (lang, sample_no, text) garbled documents are read as restored. Placeholders of an earlier redaction are no information.
    """
    docs = docs.where("row_id is not null and length(text) > 0")
    log = log.where("row_id is not null and size(tokens) > 0")
    found, logged, lexicon, contexts, log = analysed(docs, log, names, samples)
    lexicon, contexts = hinted(lexicon, 48), hinted(contexts, 96)
    parts = []
    for tbl, rows in (("documents", found), ("score_log", logged)):
        parts.append(rows.where("token is null").select(F.lit(tbl).alias("tbl"), "row_id", "kind"))
        parts.append(rows.where("kind = 'id_number'").join(contexts, "pattern", "left_semi").select(F.lit(tbl).alias("tbl"), "row_id", "kind"))
    parts.append(found.where("kind = 'name'").join(lexicon, "token", "left_semi").select(F.lit("documents").alias("tbl"), "row_id", "kind"))
    words = log.select("row_id", F.explode("tokens").alias("word")).select("row_id", F.lower(F.expr("trim(both '.,:;!?()/<>' from word)")).alias("token")).where("length(token) > 2")
    parts.append(words.join(lexicon, "token", "left_semi").select(F.lit("score_log").alias("tbl"), "row_id", F.lit("name").alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "address": "[ADDRESS]", "id_number": "[ID_NUMBER]", "name": "[NAME]"}


def redact(text: str, names: frozenset[str], contexts: frozenset[str]) -> str:
    """The text with a typed placeholder for each piece of information; neighbouring names become one."""
    flat = flatten(text)
    low = fold(flat)
    taken = forms(flat, low)
    spans = [(a, b, kind) for kind, a, b in taken]
    spans += [(a, b, "id_number") for _, context, a, b in numbers(flat, low, taken) if TRIGGER.search(context) or " ".join(context.split()[-2:]) in contexts]
    for words, _, _, _ in units(text, taken, names):
        run: list[tuple[str, int, int]] = []
        for w in [*words, ("", 0, 0)]:
            if w[0] and (fold(w[0]) in names or (w[0][-1] == "." and run == [])):
                run.append(w)
                continue
            if any(x[0][-1] != "." for x in run):
                spans.append((run[0][1], run[-1][2], "name"))
            run = []
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, log: DataFrame, names: DataFrame, samples: DataFrame | Broadcast | None = None) -> DataFrame:
    """Rows (tbl, row_id, text): documents and log lines with placeholders; null stays null, log lines are joined by blanks.

    With samples garbled documents are read, and come out, as restored.
    """
    samples = None if samples is None else sent_model(samples)
    found, logged, lexicon, contexts, _ = analysed(docs.where("row_id is not null and length(text) > 0"), log.where("row_id is not null and size(tokens) > 0"), names, samples)
    lexicon, contexts = hinted(lexicon, 48), hinted(contexts, 96)
    lines = log.select("row_id", F.array_join("tokens", " ").alias("text"))
    words = log.select("row_id", F.explode("tokens").alias("word")).select("row_id", F.lower(F.expr("trim(both '.,:;!?()/<>' from word)")).alias("token"))

    def run(batch: pa.RecordBatch) -> dict:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if samples is not None:
            some = [k for k, r in enumerate(rows) if r[0] == "documents" and r[2] is not None]
            for k, t in zip(some, readable(samples.value, [rows[k][2] for k in some]), strict=True):
                rows[k] = (*rows[k][:2], t, *rows[k][3:])
        out = [(tbl, i, None if t is None else _line(t, frozenset(n or ()), frozenset(c or ())) if tbl == "score_log" else redact(t, frozenset(n or ()), frozenset(c or ()))) for tbl, i, t, n, c in rows]
        return {"tbl": pa.array([r[0] for r in out], pa.string()), "row_id": pa.array([r[1] for r in out], pa.int64()), "text": pa.array([r[2] for r in out], pa.string())}

    out = None
    for tbl, texts, rows, tokens in (("documents", docs, found, found.where("kind = 'name'")), ("score_log", lines, logged, words)):
        # each text's own names and contexts; as many as the text holds, so that nothing grows with the corpus
        mine = tokens.join(lexicon, "token", "left_semi").groupBy("row_id").agg(F.collect_set("token").alias("names"))
        near = rows.where("kind = 'id_number'").join(contexts, "pattern", "left_semi").groupBy("row_id").agg(F.collect_set("pattern").alias("contexts"))
        part = map_arrow(texts.join(mine, "row_id", "left").join(near, "row_id", "left").select(F.lit(tbl).alias("tbl"), "row_id", "text", "names", "contexts"), run, "tbl string, row_id long, text string")
        out = part if out is None else out.unionByName(part)
    return out


def _line(text: str, names: frozenset[str], contexts: frozenset[str]) -> str:
    """A log line: words of the lexicon are names whatever their case."""
    done = redact(text, frozenset(), contexts)
    words = [PLACEHOLDERS["name"] if w.strip(".,:;!?()/<>").lower() in names else w for w in done.split(" ")]
    return re.sub(r"(\[NAME\])(?: \[NAME\])+", r"\1", " ".join(words))
