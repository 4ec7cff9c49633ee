from __future__ import annotations

from pyspark.sql import functions as F

from lettermill.operators import addresses, compare, corpus, model
from lettermill.plans import catalog

SCHEMA = "id long, tokens array<string>"


def test_near_dedup_variants_differ_on_a_chain(spark):
    words = ["w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(130)]
    df = spark.createDataFrame([(1, words[:100]), (2, words[15:115]), (3, words[30:130]), (4, [])], SCHEMA)
    greedy = {r.id: (r.seen, r.kept) for r in corpus.near_dedup_greedy(df, "id", "tokens").collect()}
    plain = {r.id: (r.seen, r.kept) for r in corpus.near_dedup(df, "id", "tokens").collect()}
    assert greedy == {1: (0, True), 2: (79, False), 3: (64, True), 4: (0, False)}
    assert plain == {1: (0, True), 2: (79, False), 3: (79, False), 4: (0, False)}


def test_best_candidate_ties_and_zeros(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 9), (2, 0, 0), (3, 0, None)], "m int, p int, s int")
    assert [tuple(r) for r in corpus.best_candidate(df, "m", "p", "s").collect()] == [(1, 1, 9)]


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, None), (3, [])], SCHEMA)
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id int")
    got = {r.id: (r.tokens, r.ids) for r in corpus.known_tokens(df, "id", "tokens", vocab).collect()}
    assert got == {1: (["b", "a", "b"], [2, 1, 2]), 2: ([], []), 3: ([], [])}
    assert tuple(corpus.coverage(df, "tokens", vocab).first()) == (4, 3)
    assert df.select(corpus.padded(F.array(F.lit(4), F.lit(5)), 4)).first()[0] == [4, 5, 0, 0]


def test_mail_boundaries(spark):
    lines = ["From a", "x", "From b", "", "x", "From c", "x"]
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)] + [("g", 0, "lead"), ("g", 1, "From z")], "f string, i int, l string")
    got = [r.msg_no for r in corpus.file_boundaries(df, "f", "i", "l").orderBy("f", "i").collect()]
    assert got == [1, 1, 1, 1, 1, 2, 2, 1, 2]


def test_running_totals_across_blocks(spark):
    rows = [(i, i % 101, (i * 7) % 101) for i in range(0, 3 * compare.BLOCK, 5000)]
    df = compare.compared(spark.createDataFrame(rows, "n long, old int, new int"), "old", "new")
    total = changed = 0
    for r in compare.running(df, "n").orderBy("n").collect():
        total += 1
        changed += r.old != r.new
        assert (r.total, r.changed, r.changed_pct) == (total, changed, 100 * changed // total)


def test_changes(spark):
    df = compare.compared(spark.createDataFrame([(10, 90), (90, 10), (1, 50), (50, 1), (99, 50), (50, 99), (50, 50)], "o int, n int"), "o", "n")
    assert "".join(r.change for r in df.collect()) == "+-?!?! "


def test_address_items():
    parse = addresses.parse_list
    assert parse('"Doe, Jo" <jo@x.example>, a@b.test') == [("jo@x.example", "Doe, Jo", None), ("a@b.test", None, None)]
    assert parse("a@b.test (The Boss)") == [("a@b.test", "The Boss", None)]
    assert parse("=?utf-8?B?w4Fn?= <a@b.test>") == [("a@b.test", "Ág", None)]
    assert parse("<>, MAILER-daemon") == [("<>", None, None), ("MAILER-DAEMON", None, None)] or parse("MAILER-daemon") == [("MAILER-DAEMON", None, None)]
    assert parse("no address here")[0][0] is None
    assert parse("a@b@c") == [(None, None, "a@b@c")]
    assert addresses.strip_layers(" \"('x')\" ") == "'x'"
    assert addresses.split_items('"a,b",(c,d),e') == ['"a,b"', "(c,d)", "e"]


def test_address_book_fold(spark):
    rows = [(1, 0, 0, "to", "A@x", "One", None), (1, 1, 0, "from", "a@x", None, None), (2, 0, 0, "cc", "a@X", "Two", None), (3, 0, 0, "from", "a@x", "Three", None), (4, 0, 0, "to", "a@x", "Four", None), (5, 0, 0, "to", None, None, "bad")]
    df = spark.createDataFrame(rows, "msg_no long, seq int, item int, hdr string, addr string, name string, error string")
    assert [tuple(r) for r in addresses.address_book(df).collect()] == [("a@x", "Three", "to,from,cc,from,to")]
    assert {r.line for r in addresses.events(df).collect()} >= {"ADDR[to]=a@x", "NAME[from]=Three"}


def test_headers_with_nulls(spark):
    df = spark.createDataFrame([(1, 0, None, "x"), (1, 1, "From", None), (1, 2, "TO", "a@b.test,\n\tB <c@d.test>"), (1, 2, "TO", "a@b.test,\n\tB <c@d.test>")], "msg_no long, seq int, name string, value string")
    assert {(r.addr, r.name) for r in addresses.addresses(df).collect()} == {("a@b.test", None), ("c@d.test", "B")}


def test_convolution_shapes(spark):
    import numpy as np

    w = model.random_weights(np.random.default_rng(0).standard_normal((50, 8)))
    ids = np.array([[1, 2, 3] + [0] * 97, [60] * 100])
    y = model.forward(ids, w)
    assert y.shape == (2, 2) and ((y > 0) & (y < 1)).all()
    # one window by hand
    e = w["embedding"][ids[0]]
    by_hand = max(np.maximum(np.concatenate((e[i], e[i + 1])) @ w["conv2"] + w["bias2"], 0)[0] for i in range(99))
    pooled = np.maximum(np.concatenate([e[:-1], e[1:]], 1) @ w["conv2"] + w["bias2"], 0).max(0)[0]
    assert abs(by_hand - pooled) < 1e-4
    df = spark.createDataFrame([(1, [1, 2]), (2, None)], "i int, ids array<int>")
    assert all(0 <= r.score <= 100 for r in model.score(df, "ids", w).collect())


def test_queries_without_sql_run(spark, data):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        assert catalog.queries()[name](spark, data).count() > 0, name


def test_written_tables_are_cleared(spark):
    from lettermill import storage

    df = storage.cut(spark.createDataFrame([(1,)], "a int"))
    assert df.count() == 1
    path = df.inputFiles()[0].removeprefix("file:")
    storage.clear(spark)
    import os

    assert not os.path.exists(path)


def _one_by_one(rows):
    owned, out = set(), {}
    for i, t in sorted(rows):
        grams = [tuple(t[k : k + 7]) for k in range(len(t) - 6)]
        seen = sum(g in owned for g in grams)
        out[i] = (seen, seen <= (len(t) - 10) * 4 / 5.0)
        if out[i][1]:
            owned.update(grams)
    return out


def test_greedy_near_dedup_settles_long_chains(spark, monkeypatch):
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, words[8 * i : 8 * i + 80]) for i in range(90)] + [(500 + i, words[1500 + 40 * i : 1560 + 40 * i]) for i in range(5)] + [(900, []), (901, words[:9])]
    df = spark.createDataFrame([*rows, (902, None)], SCHEMA)
    want = _one_by_one(rows)
    got = {r.id: (r.seen, r.kept) for r in corpus.near_dedup_greedy(df, "id", "tokens").collect()}
    assert got.pop(902)[1] is None and got == want
    # a part at a time
    monkeypatch.setattr(corpus, "SETTLE", 3000)
    assert {r.id: (r.seen, r.kept) for r in corpus.near_dedup_greedy(df, "id", "tokens").where("id <> 902").collect()} == want


def test_large_and_small_vocabularies_agree(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["b", None, "x", "a", "b", "ccc"]), (2, None), (3, []), (4, ["x"])], SCHEMA)
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("ccc", 3), (None, 4)], "token string, id int")
    rows = lambda d: {r.id: (r.tokens, r.ids) for r in d.collect()}
    small = rows(corpus.known_tokens(df, "id", "tokens", vocab))
    assert small == {1: (["b", "a", "b", "ccc"], [2, 1, 2, 3]), 2: ([], []), 3: ([], []), 4: ([], [])}
    assert rows(corpus.known_tokens(df, "id", "tokens", vocab, minlen=2))[1] == (["ccc"], [3])
    assert rows(corpus.known_tokens(df, "id", "tokens", vocab.limit(0)))[1] == ([], [])
    monkeypatch.setattr(corpus, "VOCABULARY", 1)
    assert rows(corpus.known_tokens(df, "id", "tokens", vocab)) == small


def test_first_of_each_text(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, ""), (6, "b")], "id long, t string")
    assert sorted(r.id for r in corpus.first_of_each(df, "t", "id").collect()) == [1, 2, 4, 6]
    assert corpus.first_of_each(df.limit(0), "t", "id").count() == 0


def test_lines_that_comparisons_leave_out(spark):
    ignored = compare.IGNORED.split(" ")
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["x", *ignored, "y"]), (3, ["a", "b"]), (4, []), (5, None), (6, ["c"])], "n long, t array<string>")
    assert sorted(r.n for r in compare.comparable(df, "t", "n").collect()) == [1, 4, 6]


def test_shuffle_has_every_place_once(spark):
    df = spark.range(500)
    rows = corpus.shuffled(df, "id", 3).collect()
    assert sorted(r.position for r in rows) == list(range(1, 501)) and [r.id for r in sorted(rows, key=lambda r: r.position)] != list(range(500))
    assert {r.id: r.position for r in rows} != {r.id: r.position for r in corpus.shuffled(df, "id", 4).collect()}
