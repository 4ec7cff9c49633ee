from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lettermill.functions import scores, text
from lettermill.functions.html import html_to_text

TOKENS = [
    ("1-a a-1 12-34", "#a|a|#|##|##"),
    ("e-mail my_name", "email|myname"),
    ("Wow!!! ok... a;;b !-!", "wow|!|ok|.|a|;|b|!|!"),
    ("5 db, 300Ft", "#|db|###|ft"),
    ("https://a.hu/x#frag http : //b.hu/?q=1", "httpurl|frag|httpurl"),
    ("Joe@X.hu joe@x.hu @x.hu", "joe|x|.|hu|emailaddress|emailaddress"),
    ("www.example.info 12.34.56", "domainnameo|domainname"),
    ("Árvíztűrő ß Øre ½ €5", "arvizturo|ss|ore|##|#"),
    ("Tom & Jerry; &eacute;t &#233; &amp;lt;", "tom|et|lt|;"),
    ("#a #1 a#1", "a|#|a|#"),
    ("x.y", "x|.|y"),
    ("", ""),
]
HTML = [
    ("a<!-- x -->b", "a HTMLcomment b"),
    ("a<!-->b", "a HTMLcomment b"),
    ("a<!-- open", "a"),
    ("<p>x<br>y</p>z", "\nx\nyz"),
    ("a<script>var t=1</script>b", "ab"),
    ("<script>if(a<b) x</script>y", "b) xy"),
    ('<span style="color:#ffffff">h</span>', "\nHTMLhiddenWHITE:h"),
    ('<div style="background-color:#fff;">v</div>', "\nv"),
    ('<p style="font-size:1px">h', "\nHTMLhiddenFONTSIZE:\nh"),
    ("x &amp; y", "x &amp; y"),
    ("a>b<i>c", "bc"),
    (None, None),
]


def test_tokens(spark):
    rows = spark.createDataFrame(TOKENS, "t string, e string").select("e", F.array_join(text.tokenize(F.col("t")), "|").alias("g")).collect()
    assert [r.g for r in rows] == [r.e for r in rows]
    assert spark.createDataFrame([(None,)], "t string").select(text.tokenize(F.col("t"))).first()[0] is None


def _machine(s: str) -> list[str]:
    """The lexer as a state machine, written from its description."""
    out, last = [], " "
    for c in s:
        if c.isdigit() and c.isascii():
            out.append(("" if last in " #" else " ") + "#")
            last = "#"
        elif "a" <= c <= "z":
            out.append((" " if last == "#" else "") + c)
            last = c
        elif c in "!;.":
            if c != last:
                out.append(f" {c} ")
            last = c
        elif c in "-_":
            last = c
        else:
            out.append(" ")
            last = " "
    return "".join(out).split()


def test_lexer_against_machine(spark):
    rng = random.Random(5)
    strings = ["".join(rng.choices("ab z19!;.-_#,\n", k=rng.randrange(0, 24))) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in strings], "t string").select(text.lex(F.col("t"))).collect()]
    wrong = [(s, g, _machine(s)) for s, g in zip(strings, got, strict=True) if list(g) != _machine(s)]
    assert not wrong[:3]


def test_fold_and_numeric(spark):
    table = text.fold_table()
    rng = random.Random(1)
    chars = [*table, "a", "ж", "漢", "😀", " ", "é", "ß"]
    strings = ["".join(rng.choices(chars, k=40)) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in strings], "t string").select(text.fold(F.col("t"))).collect()]
    assert got == ["".join(table.get(c, "") if ord(c) > 127 else c for c in s) for s in strings]
    cases = {"&#233;": "é", "&#xE9;": "é", "&#39;": "&#39;", "&nbsp;": "&nbsp;", "&#12ab;": None, "&#99999999;": None, "a&#x1F600;b&#300;": "a😀bĬ", "plain": "plain"}
    rows = spark.createDataFrame(list(cases.items()), "t string, e string").select("e", text.decode_numeric(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [r.e for r in rows]


def test_html(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HTML)], "i int, h string")
    got = {r.id: r.text for r in html_to_text(df, "i", "h").collect()}
    assert [got[i] for i in range(len(HTML))] == [e for _, e in HTML]


@pytest.mark.parametrize(
    ("score", "known", "online", "batch"),
    [(0.0, 99, "ham 0%", "ham-0"), (1.95, 99, "maybeham 2%", "ham-2"), (9.95, 99, "20ham 10%", "ham-maybe"), (19.95, 99, "dunno 20%", "dunno"), (50.0, 99, "dunno 50%", "dunno"), (79.95, 99, "80spam 80%", "spam-maybe"), (85.0, 99, "80spam 85%", "spam-maybe"), (89.95, 99, "maybespam 90%", "spam-90"), (95.0, 99, "maybespam 95%", "spam-95"), (98.5, 99, "spam 98%", "spam-98"), (50.0, 9, "toosmall", "toosmall")],
)
def test_verdicts(spark, score, known, online, batch):
    row = spark.createDataFrame([(score, known)], "s double, k int").select(scores.online_verdict(F.col("s"), F.col("k")), scores.batch_verdict(F.col("s"), F.col("k"))).first()
    assert tuple(row) == (online, batch)


def test_percent_and_log(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (float("nan"), 1.0), (-1.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(scores.percent(F.col("a"), F.col("b"))).collect()] == [50.0, 25.0, 50.0, 50.0]
    line = spark.createDataFrame([(7, ["a", ":", "b"])], "s int, t array<string>").select(scores.log_line(F.col("s"), F.col("t")).alias("l"))
    back = line.select("l", scores.parse_log_line(F.col("l")).alias("p")).first()
    assert back.l == "  7%:a : b" and back.p.score == 7 and back.p.tokens == ["a", ":", "b"]
