"""Parts of the operators against plain versions of themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import mincut, p1_language, p3_personal, p4_quotes, p5_encoding, p6_markup, p8_packing, p9_leaks, p10_spans
from lettermill.llm.fmindex import Bits, FMIndex, maximal_matches, suffix_array
from lettermill.llm.rolling import Hasher, winnow


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_suffix_array(xs):
    xs = [*(x + 1 for x in xs), 0]
    assert suffix_array(np.array(xs), 64).tolist() == sorted(range(len(xs)), key=lambda i: xs[i:])


def test_rank():
    bits = np.random.default_rng(0).integers(0, 2, 1000)
    b = Bits(bits)
    assert b.rank(np.arange(1001)).tolist() == [0, *np.cumsum(bits).tolist()]


@given(st.text("abc", min_size=1, max_size=80), st.text("abcd", min_size=1, max_size=4))
@settings(max_examples=80, deadline=None)
def test_backward_search_counts(text, pattern):
    code = {c: i + 1 for i, c in enumerate("abcd")}
    body = np.array([code[c] for c in text] + [0])
    index = FMIndex(body, 5, 100)
    lo, hi = np.array([0]), np.array([index.n])
    for c in reversed(pattern):
        lo, hi = index.step(np.array([code[c]]), lo, hi)
    count = sum(text.startswith(pattern, i) for i in range(len(text)))
    assert max(0, int(hi[0] - lo[0])) == count


def test_hashes_and_winnowing():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, 500)
    a[300:400] = a[100:200]
    h = Hasher(a)
    rolled = h.rolling(20)
    assert (rolled[100:181] == rolled[300:381]).all() and h.at(np.array([7]), np.array([27]))[0] == rolled[7]
    at = winnow(rolled, np.ones(len(rolled), bool), 15)
    assert np.diff(at).max() <= 15  # every window of 15 keeps one
    mine = {p - 100 for p in at if 114 <= p < 167}
    assert mine == {p - 300 for p in at if 314 <= p < 367}  # equal runs keep equal places


@pytest.mark.parametrize("seed", range(6))
def test_spans_against_all_pairs(seed):
    rng = random.Random(seed)
    base = "".join(rng.choices("ab", k=40))
    texts = ["".join(rng.choices("abc", k=rng.randrange(0, 30))) + base[rng.randrange(20) : rng.randrange(20, 41)] + "".join(rng.choices("abc", k=rng.randrange(0, 30))) for _ in range(8)]
    span, docs = 12, np.arange(8) // 2  # two texts of a record do not share with each other
    several = np.array([rng.random() < 0.2 for _ in texts])
    lane, start, end = p10_spans.shared_stretches(docs, docs + several, texts, np.ones(8, bool), span)
    got = [set() for _ in texts]
    for k, a, b in zip(lane, start, end, strict=True):
        got[k] |= set(range(a, b))
    for k, t in enumerate(texts):
        others = [u for m, u in enumerate(texts) if docs[m] != docs[k] or several[m]]
        assert got[k] == {j for i in range(len(t) - span + 1) if any(t[i : i + span] in u for u in others) for j in range(i, i + span)}


def test_suffix_automaton_parses_like_the_definition():
    text = "the cat sat on the mat and the dog sat too"
    symbols = p1_language._squeezed(p1_language._symbols(text)).tolist()
    table = p1_language.SuffixAutomaton(symbols).parser()
    query = p1_language._symbols("the mat sat on a cat then").tolist()
    state = fails = 0
    for c in query:
        to = int(table[state, c])
        fails += to & 1
        state = to >> 1
    has = lambda xs: any(symbols[i : i + len(xs)] == xs for i in range(len(symbols)))
    phrases, at = 0, 0
    while at < len(query):
        size = 1
        while at + size < len(query) and has(query[at : at + size + 1]):
            size += 1
        at += size
        phrases += 1
    assert fails + 1 in (phrases, phrases + 1)


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.data())
@settings(max_examples=60, deadline=None)
def test_minimum_cut(unary, data):
    n = len(unary)
    edges = [(i, j, data.draw(st.floats(0, 2))) for i in range(n) for j in range(i + 1, n) if data.draw(st.booleans())]
    cost = lambda lab: sum(max(0, -u) if x else max(0, u) for u, x in zip(unary, lab, strict=True)) + sum(w for i, j, w in edges if lab[i] != lab[j])
    best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
    assert abs(cost(mincut.label(unary, edges)) - best) < 1e-6


@given(st.lists(st.integers(1, 20), max_size=40))
@settings(max_examples=60, deadline=None)
def test_first_fit(sizes):
    got = p8_packing.first_fit_decreasing(sizes, 20)
    room, want = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for b, r in enumerate(room):
            if r >= sizes[k]:
                break
        else:
            b = len(room)
            room.append(20)
        room[b] -= sizes[k]
        want[k] = b
    assert got == want


def test_edit_distance_and_embedding():
    a = np.array([1, 2, 3, 4, 5])
    assert p9_leaks.within(a, np.array([1, 9, 3, 4, 5]), 1) and not p9_leaks.within(a, np.array([9, 9, 3, 4, 5]), 1)
    assert p9_leaks.within(a, np.array([2, 3, 4, 5, 6]), 2) and not p9_leaks.within(a, a[::-1], 2)
    w = np.random.default_rng(1).integers(1, 50, (200, 16)).astype(np.uint32)
    assert (p9_leaks.embed(w, 3, 6, 9) == p9_leaks.embed(w.copy(), 3, 6, 9)).all()
    near = w.copy()
    near[:, 8] += 100
    tables = p9_leaks.tables_for(0.95, 1, 6, 16)
    met = (p9_leaks.embed(w, tables, 6, 9) == p9_leaks.embed(near, tables, 6, 9)).any(0)
    assert met.mean() >= 0.9


CLEAN = {"hu": ["Szerencsére a szűrőbetét még mindig vízálló, pedig a gépkönyv már megjött.", "Közben kiderült, hogy az öntözőcső ára 45 Ft lett, és erről hétfőn beszélünk."], "fr": ["L'équipe a changé après le jour férié des pièces du tampon d'arrivée.", "Où est le garçon ? Malheureusement la bâche coûte 40 €."]}


@pytest.mark.parametrize("steps", [(("utf-8", "cp1252"),), (("utf-8", "latin-1"), ("utf-8", "latin-1")), (("utf-8", "mac-roman"),), (("cp1250", "cp852"),), (("utf-8", "iso8859-2"),)])
def test_garbled_text_comes_back(steps):
    model = p5_encoding.Model(CLEAN)
    text = "Kérjük, hogy az előjegyzés kerüljön vissza a jegyzőkönyv mellé,\nde ezt még ellenőrizni kell."
    garbled = p5_encoding.Chain(steps).garble(text)
    assert p5_encoding.repair(model, [text, garbled, "plain ascii", ""])[0][:2] == (1, text)
    assert not p5_encoding.repair(model, [text])


def test_codecs_and_lost_letters():
    assert [p5_encoding.declared(x) for x in (None, " ", "latin2", "x-none", "utf8")] == ["utf-8", "iso8859-2", "iso8859-2", "utf-8", "utf-8"]
    found = p5_encoding.repair(p5_encoding.Model(CLEAN), ["fest�k sz�r�"])
    assert found[0][0] == 0 and found[0][3] is False


MAIL = """Hello Anna,

this is new.
From Monday on: still new

> quoted
>> deeper
Also new.

On 2021-05-09 15:02, Paula Wen
wrote:
| soft mark
| more

Best regards,
Jo Doe
shift lead

********

This message is confidential and meant for the addressee only.

=== Original Message ===
 From: A B
 Sent: 2020-01-01
 Subject: x

old text
"""


def test_layout():
    lines = MAIL.split("\n")
    new = {"Hello Anna,", "this is new.", "From Monday on: still new", "Also new."}
    assert {lines[k - 1] for k in p4_quotes.old_lines(MAIL)} == {x for x in lines if x.strip()} - new
    assert p4_quotes.written(MAIL) == "Hello Anna,\n\nthis is new.\nFrom Monday on: still new\n\nAlso new."
    tree = p4_quotes.parse(MAIL.split("\n"))
    assert [n.kind for n in tree] == ["quoted", "quoted", "closing", "notice", "forward"] and tree[0].inside[0].kind == "quoted"
    assert p4_quotes.old_lines("") == [] and p4_quotes.old_lines("\n\n") == []


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("a <b>x</b>", ["html"]), ("x &nbsp; y", ["html"]), ("Tom & Jerry; <jo@x.example> 3 < 4 > 2", []),
        ("# Title\n\n- a\n- b", ["markdown"]), ("- a\n- b", []), ("Title\n=====\n\nx", ["markdown"]), ("see [x](https://a.example)", ["markdown"]),
        ("== To do ==\n* [[x]]", ["wiki"]), ("=== Original Message ===\nFrom: a\nSent: b", []), ("***** Eredeti üzenet *****", []),
        ("\\section{A}", ["latex"]), ("$\\frac{a}{b}$", ["latex"]), ("C:\\temp\\new and $5.50 for $6.50", []), ("~~~~~~\nJo\nboss", []), ("", []),
    ],
)
def test_kinds(text, found):
    assert p6_markup.kinds(text) == found


def test_conversion_keeps_structure():
    text = "<html><head><title>t</title><style>x{}</style></head><body><h2>Head</h2><p>One sentence, long enough to count as text.</p><ul><li>item one</li><li>item two</li></ul><pre><code>if a &lt; b:\n  c</code></pre><script>var x=1;</script><!-- gone --></body></html>"
    out = p6_markup.clean(text)
    assert "## Head" in out and "- item one" in out and "```\nif a < b:\n  c\n```" in out and "var x" not in out and "gone" not in out
    assert p6_markup.clean("== H ==\n* [[a|b]] c\n'''bold'''") == "## H\n- b c\nbold"
    assert p6_markup.clean("\\section{H}\n\\begin{itemize}\n\\item a\n\\end{itemize}\nx $\\frac{1}{2}$") == "## H\n- a\nx $\\frac{1}{2}$"
    assert p6_markup.clean("# H\n\n**b** [t](https://x.example)\n\n```\nco**de**\n```") == "# H\n\nb t\n\n```\nco**de**\n```"


def test_forms():
    text = "Write to jo.doe@x.example or anna @ y . test or bo [at] z [dot] test.\nCall +36 55\n555 1234 or 555-0129; order 4174-14141.\nWe live at 12 Elm Street, or Fő utca 5., or 98, impasse Lilas; not at the place."
    flat = p3_personal.flatten(text)
    kinds = [k for k, _, _ in p3_personal.forms(flat, p3_personal.fold(flat))]
    assert kinds.count("email") == 3 and kinds.count("phone") == 2 and kinds.count("address") == 3
    out = p3_personal.redact("Dear Anna Doe,\nmy passport no. is 123 456 789, order 123 456 789.", frozenset({"anna", "doe"}), frozenset())
    assert out == "Dear [NAME],\nmy passport no. is [ID_NUMBER], order 123 456 789."


def test_matches_in_small_turns(monkeypatch):
    from lettermill.llm import p2_splits

    rng = np.random.default_rng(4)
    held = [rng.integers(0, 6, 30) for _ in range(6)]
    asked = [np.concatenate((h[:12], [9], h[13:])) for h in held] + [rng.integers(20, 30, 30)]
    flat = lambda xs: (np.concatenate(xs).astype(np.uint64), np.cumsum([0, *map(len, xs)]))
    shard = p2_splits.Shard.of(p2_splits.Shard(np.arange(100, 106), *flat(held)).packed())
    whole = [x.tolist() for x in shard.alike(np.arange(7), *flat(asked), 0.5)]
    assert list(zip(*whole[:2], strict=True)) == [(k, 100 + k) for k in range(6)]
    monkeypatch.setattr(p2_splits, "OCCURRENCES", 2)
    assert [x.tolist() for x in shard.alike(np.arange(7), *flat(asked), 0.5)] == whole
    assert all(len(x) == 0 for x in shard.alike(np.arange(1), *flat(asked[6:]), 0.5))


@pytest.mark.parametrize(("symbols", "size"), [(2, 40), (3, 200), (4, 300), (40, 25)])
def test_all_alike_records_are_found(symbols, size):
    from lettermill.llm import p2_splits
    from lettermill.llm.tokensets import distinct_sorted, trigrams

    rng = np.random.default_rng(symbols)
    held = [rng.integers(0, symbols, rng.integers(20, size + 1)) for _ in range(30)]
    asked = [np.concatenate((h[: k % 20], rng.integers(0, symbols + 1, k % 4), h[k % 20 :])) for k, h in enumerate(held)] + [np.tile(held[0][:6], 20)]
    flat = lambda xs: (np.concatenate(xs).astype(np.uint64), np.cumsum([0, *map(len, xs)]))
    grams = lambda xs: [set(v[a:b].tolist()) for v, at in [distinct_sorted(*trigrams(*flat(xs)))] for a, b in zip(at[:-1], at[1:], strict=True)]
    x, y = grams(asked), grams(held)
    want = {(i, j) for i, p in enumerate(x) for j, q in enumerate(y) if len(p & q) >= 0.7 * len(p | q)}
    a, b, _ = p2_splits.Shard(np.arange(30), *flat(held)).alike(np.arange(31), *flat(asked), 0.7)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and want


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.95, 1.0])
@pytest.mark.parametrize(("symbols", "size"), [(2, 40), (3, 200), (6, 60), (40, 25)])
def test_first_trigrams_of_alike_records_meet(symbols, size, threshold):
    from lettermill.llm.prefixes import COUNTERS, first_trigrams
    from lettermill.llm.tokensets import distinct_sorted, trigrams

    rng = np.random.default_rng(symbols)
    held = [rng.integers(0, symbols, rng.integers(20, size + 1)) for _ in range(40)]
    asked = [np.concatenate((h[: k % 20], rng.integers(0, symbols + 1, k % 12), h[k % 20 + k % 5 :])) for k, h in enumerate(held)] + [np.tile(held[0][:6], 20)]
    flat = lambda xs: (np.concatenate(xs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.cumsum([0, *map(len, xs)]))
    grams = lambda xs: [set(v[a:b].tolist()) for v, at in [distinct_sorted(*trigrams(*flat(xs)))] for a, b in zip(at[:-1], at[1:], strict=True)]
    x, y = grams(asked), grams(held)
    want = {(i, j) for i, p in enumerate(x) for j, q in enumerate(y) if len(p & q) >= threshold * len(p | q)}
    counts = rng.integers(0, 50, COUNTERS).astype(np.uint64)  # whatever the order, no pair is lost
    left, right = (list(zip(*first_trigrams(*flat(xs), counts, threshold, side), strict=True)) for xs, side in ((asked, False), (held, True)))
    met = set()
    for key, i, n, p, bits in left:
        for other, j, m, q, more in right:
            shared = int(np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9))
            if key == other and p <= n - shared and q <= m - shared and np.bitwise_count((bits ^ more).view(np.uint64)).sum() <= n + m - 2 * shared:
                met.add((i, j))
    assert want <= met and want


def test_weak_markup_lines_win_together():
    kinds = p6_markup.kinds
    assert kinds("Shopping:\n" + "".join(f"- item {k}\n" for k in range(30)) + "Bye") == ["markdown"]
    assert kinds("Steps\n\n1. open\n\n2. read\n\n3. close\n\nBye") == ["markdown"]
    assert kinds("Prices\n| a | b |\n| 1 | 2 |\n| 3 | 4 |\nBye") == ["markdown"]
    assert kinds("Terms\n; mail : letter\n; list : letters\n; spam : junk\nBye") == ["wiki"]
    assert "wiki" in kinds("Parts\n* body\n** head\n** tail\n* end\nBye")
    assert kinds("Sets\n$a$ is one\n$b$ is two\n$c$ is three\nBye") == ["latex"]
    # a lone dash or date, mail quotes and separators are none
    for text in ("We met\n- by chance -\nthere", "Born\n20. 2. 1999\nthere", "He wrote\n: one\n: two\n: three\n: four\n", "He wrote\n| one\n| two\n| three\n|\n| four\n", "Hi\n\n-- \nJo\n", "*****\n***** Text *****\n*****"):
        assert kinds(text) == [], text


def test_letters_of_other_languages_are_judged(data):
    import duckdb

    samples: dict[str, list[str]] = {}
    for lang, text in duckdb.sql(f"SELECT lang, text FROM '{data}/lang_samples.parquet' ORDER BY lang, sample_no").fetchall():
        samples.setdefault(lang, []).append(text)
    model = p5_encoding.Model(samples)
    for text in ("A fű zöld, és fél öt van.", "Az őszi körlevél még nem érkezett meg.", "Később küldöm a szűrőt, köszönöm.", "Tudjuk, hogy erről hétfőn beszélünk."):
        for chain in ((("iso8859-2", "latin-1"),), (("cp1250", "cp1252"),), (("iso8859-2", "iso8859-15"),)):
            garbled = p5_encoding.Chain(chain).garble(text)
            assert garbled != text and [r[1] for r in p5_encoding.repair(model, [garbled])] == [text], garbled
    # names and words of other languages, capitals and marks are no misread letters
    clean = ["Guten Tag Änne,", "Étienne Nopra", "Merci d’avance,", "Szia Ágnes!", "Dear Gergő,", "Das kostet 45 €.", "¡De acuerdo, gracias!", "Șeful de depozit", "Hello François and Zoltánné"]
    assert [r[0] for r in p5_encoding.repair(model, clean)] == []


@given(st.text("abc", min_size=1, max_size=60), st.lists(st.text("abcd", max_size=25), min_size=1, max_size=4), st.integers(1, 5))
@settings(max_examples=120, deadline=None)
def test_maximal_matches(text, texts, least):
    code = {c: i + 1 for i, c in enumerate("abcd")}
    index = FMIndex.of(FMIndex(np.array([code[c] for c in text] + [0]), 5, 100).arrays())
    starts = np.cumsum([0, *map(len, texts)])
    rows = maximal_matches(index, np.array([code[c] for t in texts for c in t], np.int64), starts, least)
    got = [(k, s - starts[k], e - starts[k], hi - lo) for k, s, e, lo, hi in zip(*rows, strict=True)]
    want = []
    for k, t in enumerate(texts):
        for s in range(len(t)):
            for e in range(s + least, len(t) + 1):
                longer = (s > 0 and t[s - 1 : e] in text) or (e < len(t) and t[s : e + 1] in text)
                if t[s:e] in text and not longer:
                    want.append((k, s, e, sum(text.startswith(t[s:e], i) for i in range(len(text)))))
    assert got == want


def test_names_behind_labels_and_in_greetings_are_replaced():
    names = frozenset({"kovacs", "zoltanne", "anna"})
    redact = lambda t: p3_personal.redact(t, names, frozenset())
    assert redact("Ügyintéző: Kovács Zoltánné, raktár") == "Ügyintéző: [NAME], raktár"
    assert redact("Kovács Anna, kérem") == "[NAME], kérem" and redact("Kedves Anna!") == "Kedves [NAME]!" and redact(": Kedves Anna, ez") == ": Kedves [NAME], ez"


def test_the_cut_decides_about_weak_lines(monkeypatch):
    texts = ["He said\n- a word\n- another\nand left", "Shopping:\n- one\n- two\n- three\nBye", "Sum\n| a | b |\n| 1 | 2 |\nBye"]
    cut = [p6_markup.kinds(t) for t in texts]
    assert cut == [[], ["markdown"], []]
    # without the edges each line would go by its own vote
    monkeypatch.setattr(p6_markup, "label", lambda votes, edges: [v > 0 for v in votes])
    assert [p6_markup.kinds(t) for t in texts] == [["markdown"]] * 3
