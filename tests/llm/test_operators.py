"""Whole operators: against brute force on the small tables, and on rows with every odd case."""

from __future__ import annotations

import glob
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lettermill import storage
from lettermill.llm import p1_language, p2_splits, p3_personal, p4_quotes, p5_encoding, p6_markup, p7_near, p8_packing, p9_leaks, p10_spans, queries, tokensets

DOCS = "doc_id long, text string, lang string, source string, n_tok int, ctype string, doc int, fp int, rep int, kind int, size int, key int"
CORPUS = "id long, tokens array<string>, label int, split string, src_file string, source string, rep int, key int, keys int, n int, a int"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns named like inner ones."""
    rest = (None,) * 7
    long = "Ez egy hosszú szöveg, amely sokszor ismétlődik. " * 20_000
    rows = [(1, None, "hu", None, None, *rest), (None, "text", None, None, 3, *rest), (2, "", "", "s", 0, *rest), (3, long, "hu", "s", None, *rest), (4, "x", None, None, 1, *rest), (4, "x", None, None, 1, *rest), (5, "\ud83d\ude00 𝔘 \x00 é\r\n", "xx", "", -1, *rest)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def samples(spark, data):
    return spark.read.parquet(f"{data}/lang_samples.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _jaccard_pairs(rows, least, ok):
    sets = [(i, s, frozenset(zip(t, t[1:], t[2:], strict=False))) for i, t, s in rows if t and len(t) >= 20]
    out = set()
    for (i, s, x), (j, r, y) in itertools.combinations(sets, 2):
        if i != j and ok(s, r) and len(x & y) >= least * len(x | y):
            out.add((min(i, j), max(i, j)))
    return out


def test_pairs_against_all_pairs(spark, data):
    rows = duckdb.sql(f"SELECT id, tokens, split FROM '{data}/mail_corpus.parquet'").fetchall()
    near = _jaccard_pairs(rows, 0.5, lambda a, b: a == b == "train")
    got = {tuple(r) for r in queries.p7_found(spark, data).collect()}
    assert got <= near and len(got) >= 0.97 * len(near)
    cross = _jaccard_pairs(rows, 0.7, lambda a, b: {a, b} == {"train", "validation"})
    assert {tuple(r) for r in queries.p2_found(spark, data).collect()} == cross


def test_small_shards_and_buckets_change_nothing(spark, data):
    corpus = spark.read.parquet(f"{data}/mail_corpus.parquet")
    assert {tuple(r) for r in p2_splits.overlaps(corpus, shard_tokens=300).collect()} == {tuple(r) for r in queries.p2_found(spark, data).collect()}
    _, reps = tokensets.classes(p7_near._train(corpus, 20))
    whole = {(r.a, r.b) for r in p7_near.similar_classes(reps, 0.5).collect()}
    split = {(r.a, r.b) for r in p7_near.similar_classes(reps, 0.5, bucket=2).collect()}
    assert split == whole


def test_pairs_without_a_pass_over_every_shard(spark):
    rng = random.Random(3)
    held = [[f"t{rng.randrange(k % 4 * 20 + 3)}" for _ in range(rng.randrange(20, 60))] for k in range(60)]
    train = [h[: k % 15] + [f"t{rng.randrange(9)}" for _ in range(k % 4)] + h[k % 15 + k % 3 :] for k, h in enumerate(held)]
    rows = [(k, t, "train") for k, t in enumerate(train)] + [(1000 + k, h, "validation") for k, h in enumerate(held)] + [(2000, held[0], "train"), (2001, train[1], "validation")]
    folder = storage.shared_dir(spark).removeprefix("file://")
    shards = lambda: set(glob.glob(f"{folder}/*/shard=*"))
    df, before = spark.createDataFrame(rows, "id long, tokens array<string>, split string"), shards()
    for least in (0.5, 0.7, 1.0):
        want = _jaccard_pairs([(i, t, s) for i, t, s in rows], least, lambda a, b: a != b)
        assert {tuple(r) for r in p2_splits.overlaps(df, least, shard_tokens=100).collect()} == want and want
    assert shards() == before


def test_hot_group_of_copies(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(30)]
    rows = [(i, base, None, "train" if i % 3 else "validation", None, "hot", *(None,) * 5) for i in range(60)]
    rows += [(100 + i, [f"v{rng.randrange(10_000)}" for _ in range(25)], None, "train", None, None, *(None,) * 5) for i in range(60)]
    rows += [(200, [*base[:15], "new", *base[15:]], None, "train", None, None, *(None,) * 5), (200, [*base[:15], "new", *base[15:]], None, "train", None, None, *(None,) * 5)]
    rows += [(300, None, None, "train", None, None, *(None,) * 5), (301, [], None, None, None, None, *(None,) * 5), (302, [None, "a"], None, "train", None, None, *(None,) * 5), (None, base, None, "train", None, None, *(None,) * 5)]
    df = spark.createDataFrame(rows, CORPUS)
    assert p7_near.near_pairs(df).count() == 40 * 39 // 2 + 40
    groups = {r.id: r for r in p7_near.near_groups(df, 0.5).collect()}
    assert groups[1].copies == 40 and groups[1].links == 1 and groups[200].links == 1 and groups[100].links == 0 and 300 not in groups
    assert p2_splits.overlaps(df).count() == 20 * 41
    counts = {(r["split"], r["source"]): r for r in p2_splits.overlap_counts(df).collect()}
    assert (counts["validation", "hot"].overlapping, counts["validation", "hot"].links) == (20, 20 * 41) and counts["train", "hot"].overlapping == 40
    assert p2_splits.matched_spans(df).where("id = 200").count() == 2
    empty = df.limit(0)
    assert p7_near.near_pairs(empty).count() == p7_near.near_groups(empty).count() == p2_splits.overlaps(empty).count() == p2_splits.overlap_counts(empty).count() == p2_splits.matched_spans(empty).count() == 0


def test_spans(spark, data, odd_docs, none):
    docs = [(i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall() if t]
    seen = {}
    for i, t in docs:
        for k in range(len(t) - 199):
            seen.setdefault(t[k : k + 200], set()).add(i)
    truth = {i for s in seen.values() if len(s) > 1 for i in s}
    assert {r.doc_id for r in queries.p10_found(spark, data).collect()} == truth
    share = {r.doc_id: r.shared_chars for r in queries.p10_share(spark, data).collect()}
    assert share.keys() == truth
    for i, t in docs:
        if i in truth:
            covered = {j for k in range(len(t) - 199) if len(seen[t[k : k + 200]]) > 1 for j in range(k, k + 200)}
            assert share[i] == len(covered)
    assert p10_spans.sharing_documents(none).count() == p10_spans.shared_share(none).count() == 0
    hot = spark.createDataFrame([(i, f"{i} " * 30 + "shared passage that is long enough to be found everywhere. " * 4 + f" {i * 7}" * 30) for i in range(40)] + [(99, "alone " * 50)], "doc_id long, text string")
    want = {tuple(r) for r in p10_spans.shared_spans(hot).collect()}
    assert {r[0] for r in want} == set(range(40))
    before = p10_spans.GROUP
    try:
        for p10_spans.GROUP in (3, 30):
            assert {r.doc_id for r in p10_spans.sharing_documents(hot).collect()} == set(range(40))
            assert {tuple(r) for r in p10_spans.shared_spans(hot).collect()} == want
    finally:
        p10_spans.GROUP = before
    # a text that repeats only itself shares nothing; a copy of it does
    assert p10_spans.sharing_documents(odd_docs).count() == 0
    assert {r.doc_id for r in p10_spans.sharing_documents(odd_docs.unionByName(odd_docs.where("doc_id = 3").withColumn("doc_id", F.lit(9).cast("long")))).collect()} == {3, 9}


def test_leaks(spark, data, odd_docs, none):
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/heldout_items.parquet'").fetchall()
    index = {}
    for i, t in items:
        w = p9_leaks.words(t)
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(i)
    truth = set()
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall():
        w = p9_leaks.words(t or "")
        for k in range(len(w) - 11):
            truth |= {(d, i) for i in index.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in queries.p9_found(spark, data).collect()} == truth
    held = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "x"), (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "ONE two, three > four five\n> six seven eight nine ten eleven twelve!"), (2, "one two three four five six CHANGED eight nine ten eleven twelve thirteen fourteen"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in p9_leaks.leaks(docs, held).collect()} == {(1, 4, True)}
    assert {tuple(r) for r in p9_leaks.leaks(docs, held, width=14, edits=1, sampled=4).collect()} == {(2, 4, False)}
    assert {tuple(r) for r in p9_leaks.leaks(docs, held, width=12, edits=1, sampled=4).collect()} == {(1, 4, True), (2, 4, False)}
    assert p9_leaks.leaks(none, held).count() == p9_leaks.leaks(odd_docs, held.limit(0)).count() == p9_leaks.leaks(odd_docs, held).count() == 0


def test_near_leaks_reach_the_recall(spark, data):
    rng = random.Random(2)
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/heldout_items.parquet'").fetchall()
    rows = []
    for i, t in items:
        w = p9_leaks.words(t)
        if len(w) >= 20:
            w = w[:16]
            w[rng.randrange(3, 13)] = "changed"
            rows.append((i, "before it " + " ".join(w) + " behind"))
    got = {tuple(r) for r in p9_leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{data}/heldout_items.parquet"), width=16, edits=1, sampled=6).drop("whole").collect()}
    assert sum((i, i) in got for i, _ in rows) >= 0.9 * len(rows)


def test_language(spark, samples, odd_docs, none):
    hu = "Szerencsére a tartalék akkumulátor még mindig külföldi, pedig a műszaki rajz már megjött. Kérjük, hogy a gépkönyv kerüljön vissza a raktárkulcs mellé."
    de = "Inzwischen wissen wir, die Kaffeemaschine ist noch da. Das Büro meint, bitte stellt die Zeltplane wieder neben die Rohrschelle und darüber sprechen wir morgen."
    rows = [(1, hu, "hu"), (2, hu, "de"), (3, hu, None), (4, hu + "\n\n" + de, "hu"), (5, hu, "HU-hu"), (6, de, " "), (7, "Igen.", None), (8, hu, "hu_HU")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in p1_language.mislabelled(df, samples).collect()} == {(2, "hu"), (3, "hu"), (4, "hu"), (4, "de"), (6, "de")}
    parts = [r.lang for r in p1_language.segments(df.where("doc_id = 4"), samples).orderBy("segment").collect()]
    assert parts == ["hu", "de"]
    assert p1_language.mislabelled(none, samples).count() == 0 and p1_language.mislabelled(odd_docs, samples.limit(0)).count() == p1_language.segments(odd_docs, samples.limit(0)).count() == 0
    assert {r.doc_id for r in p1_language.mislabelled(odd_docs, samples).collect()} == set()
    held = samples.where("sample_no > 30")
    got = p1_language.segments(held.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("lang").alias("said")), samples.where("sample_no <= 30"))
    joined = got.join(held.select(F.monotonically_increasing_id().alias("doc_id"), F.col("lang").alias("said")), "doc_id")
    assert joined.where("lang = said").count() >= 0.97 * joined.count()


def test_encoding(spark, samples, odd_docs, none):
    parts = spark.createDataFrame(
        [(1, 0, "text/plain", "utf-8", "é".encode()), (2, 0, "text/plain", "utf-8", "szűrőbetét még".encode("cp1250")), (3, 0, "TEXT/html; x", "iso-8859-2", "szűrőbetét még mindig".encode()), (4, 0, "application/pdf", None, b"\xff"), (5, 0, "text/plain", None, None), (6, 0, "text/plain", "none", b""), (None, 0, None, None, b"x"), (7, 0, "text/plain", "koi8-r", b"plain"), (2, 0, "text/plain", "utf-8", "szűrőbetét még".encode("cp1250"))],
        "msg_no long, part_no int, ctype string, charset string, payload binary",
    )
    got = {r.row_id: r.restored for r in p5_encoding.garbled_parts(parts, samples).collect()}
    assert got == {2: "szűrőbetét még", 3: "szűrőbetét még mindig"}
    assert p5_encoding.garbled_documents(odd_docs, samples).where("row_id = 3").count() == 0
    assert p5_encoding.garbled_documents(none, samples).count() == p5_encoding.garbled_parts(parts.limit(0), samples).count() == p5_encoding.garbled_documents(odd_docs, samples.limit(0)).count() == 0


def test_held_out_chains_are_restored(spark, samples):
    rows = [r.text for r in samples.where("sample_no > 20 and lang in ('hu', 'fr')").collect()]
    model = p5_encoding.build(samples.where("sample_no <= 20"))
    total = right = 0
    for chain in (p5_encoding.Chain((("utf-8", "cp1252"),)), p5_encoding.Chain((("cp1250", "cp852"),)), p5_encoding.Chain((("utf-8", "latin-1"), ("utf-8", "latin-1")))):
        for t in rows:
            g = chain.garble(t)
            if g != t and chain.restore(g) == t:
                total += 1
                found = p5_encoding.repair(model, [g])
                right += bool(found) and found[0][1] == t
    assert right >= 0.93 * total > 0


def test_mail_and_markup_rows(spark, samples, odd_docs, none):
    assert p4_quotes.not_written(none, samples).count() == p6_markup.with_markup(none).count() == p6_markup.cleaned(none).count() == p4_quotes.newly_written(none).count() == 0
    assert p4_quotes.not_written(odd_docs, samples).count() == 0 and p6_markup.with_markup(odd_docs).count() == 0
    assert p6_markup.cleaned(odd_docs).where("doc_id = 1 and clean is null").count() == 1 and p4_quotes.newly_written(odd_docs).count() == odd_docs.count()
    df = spark.createDataFrame([(1, "new\n\n> old\n>\n> old"), (1, "new\n\n> old\n>\n> old"), (2, "<p>html</p>\n> x"), (3, "Üdv,\r\nJo\r\n")], "doc_id long, text string")
    assert {tuple(r) for r in p4_quotes.not_written(df, samples).collect()} == {(1, 3), (1, 4), (1, 5), (3, 1), (3, 2)}


def test_personal(spark, samples, none):
    docs = spark.createDataFrame(
        [(i, f"Dear Anna Doe{i % 3}x,\n\nplain words here.\n\nCheers,\nAnna Doex") for i in range(8)] + [(20, "Call +36 55 555 1234, tax id: 12 345 678."), (21, None), (22, ""), (None, "Anna"), (23, "it was Doex at 5 Elm Street, a@b.example"), (24, "Nothing to see. Order number 12 345 678.")],
        "row_id long, text string",
    )
    log = spark.createDataFrame([(1, ["the", "key", "of", "anna", None]), (2, None), (3, []), (None, ["anna"]), (4, ["flat", "#", "##", "elm", "street"]), (5, ["emailaddress", "##", "###", "####"]), (1, ["the", "key", "of", "anna", None])], "row_id long, tokens array<string>")
    names = spark.createDataFrame([("Anna",), (None,), ("",)], "name string")
    got = {(r.tbl, r.row_id, r.kind) for r in p3_personal.personal(docs, log, names, samples).collect()}
    want = {("documents", i, "name") for i in (*range(8), 23)} | {("documents", 20, "phone"), ("documents", 20, "id_number"), ("documents", 23, "email"), ("documents", 23, "address"), ("score_log", 1, "name"), ("score_log", 4, "address")}
    assert got == want
    out = {(r.tbl, r.row_id): r.text for r in p3_personal.redacted(docs, log, names).collect() if r.row_id is not None}
    assert out["documents", 20] == "Call [PHONE], tax id: [ID_NUMBER]." and out["documents", 21] is None and out["score_log", 1] == "the key of [NAME]" and out["documents", 24] == "Nothing to see. Order number 12 345 678."
    nothing = none.select(F.col("doc_id").alias("row_id"), "text")
    assert p3_personal.personal(nothing, log.limit(0), names.limit(0)).count() == 0


def test_packing(spark, data, odd_docs, none):
    specs = spark.read.parquet(f"{data}/pack_spec.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    packed = p8_packing.pack(docs, specs, group_items=30).cache()
    sized = {r.doc_id: r.size for r in p8_packing.sized(docs).collect()}
    caps = {r.spec_id: r.capacity for r in specs.collect()}
    totals = {(r.spec_id, r.doc_id): (r.t, r.n) for r in packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    assert totals.keys() == {(s, d) for s in caps for d in sized}
    assert all(t == sized[d] and n == -(-sized[d] // caps[s]) for (s, d), (t, n) in totals.items())
    assert all(r.t <= caps[r.spec_id] for r in packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t")).collect())
    whole = p8_packing.fill(p8_packing.pack(docs, specs), specs).collect()
    assert all(r.fill > 0.9 for r in whole if r.tokens > 20 * r.capacity)
    assert p8_packing.pack(none, specs).count() == p8_packing.pack(odd_docs, specs.limit(0)).count() == 0
    assert {r.doc_id for r in p8_packing.pack(odd_docs, specs).collect()} == {3, 4}


def test_garbled_mail_is_written_and_redacted_as_restored(spark, samples):
    clean = "Kérjük, a szűrőbetét még mindig a régi helyén legyen.\n\n2024. 05. 03. 10:12 keltezéssel Kovács Anna írta:\n: Az őszi szállítmány már megérkezett.\n: Köszönöm a gyors választ."
    garbled = clean.encode().decode("latin-1")
    docs = spark.createDataFrame([(1, garbled), (2, None), (3, clean)], "doc_id long, text string")
    out = {r.doc_id: r.written for r in p4_quotes.newly_written(docs, samples).collect()}
    old = {(r.doc_id, r.line_no) for r in p4_quotes.not_written(docs, samples).collect()}
    assert (1, 4) in old and {k for d, k in old if d == 1} == {k for d, k in old if d == 3}
    assert out == {1: garbled.split("\n")[0], 2: None, 3: clean.split("\n")[0]}
    text = "Tisztelt Márton Ödön, a szűrőbetét még mindig a régi helyén van.\nSzemélyi igazolványom száma: 123456AB."
    rows = spark.createDataFrame([(1, text.encode().decode("latin-1")), (2, None), (3, text)], "row_id long, text string")
    log = spark.createDataFrame([], "row_id long, tokens array<string>")
    names = spark.createDataFrame([("Márton",), ("Ödön",)], "name string")
    got = {r.row_id: r.text for r in p3_personal.redacted(rows, log, names, samples).collect()}
    assert "[NAME]" in got[3] and got[1] == got[3] and got[2] is None


def test_near_leaks_find_added_and_dropped_words(spark, data):
    rng = random.Random(5)
    items = duckdb.sql(f"SELECT item_id, text FROM '{data}/heldout_items.parquet'").fetchall()
    held = spark.read.parquet(f"{data}/heldout_items.parquet")
    for kind in ("insert", "drop", "replace"):
        rows: list[tuple[int, int, str]] = []
        for i, t in items:
            w = p9_leaks.words(t)
            for _ in range(4 if len(w) >= 20 else 0):
                s, k = rng.randrange(len(w) - 15), rng.randrange(1, 15)
                p = w[s : s + 16]
                p[k : k + (kind != "insert")] = [] if kind == "drop" else ["changed"]
                rows.append((len(rows), i, " ".join(p) if len(rows) % 2 else "before it " + " ".join(p) + " behind"))
        docs = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")
        got = {tuple(r) for r in p9_leaks.leaks(docs, held, width=16, edits=1, sampled=6, recall=0.95).drop("whole").collect()}
        assert sum((d, i) in got for d, i, _ in rows) >= 0.95 * len(rows)


def test_matched_spans_are_whole(spark, data):
    rng = random.Random(3)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    base = [f"w{k}" for k in range(40)]
    rows = [(1, base, "validation"), (2, [*fresh(4), *base[5:13], *fresh(11), *base[20:29], *fresh(10)], "train"), (3, [*fresh(12), *base[10:17], *fresh(6)], "train")]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, split string").withColumn("source", F.lit(None).cast("string"))
    assert {tuple(r) for r in p2_splits.matched_spans(df).collect()} == {(2, 4, 12), (2, 23, 32)}
    records = [(i, [x for x in t if x is not None], s) for i, t, s in duckdb.sql(f"SELECT id, tokens, split FROM '{data}/mail_corpus.parquet' WHERE id IS NOT NULL AND tokens IS NOT NULL").fetchall()]
    runs = {tuple(t[k : k + 8]) for _, t, s in records if s == "validation" and len(t) >= 20 for k in range(len(t) - 7)}
    want = set()
    for i, t, s in records:
        if s != "train" or len(t) < 20:
            continue
        covered = sorted({j for k in range(len(t) - 7) if tuple(t[k : k + 8]) in runs for j in range(k, k + 8)})
        for _, part in itertools.groupby(enumerate(covered), lambda x: x[1] - x[0]):
            part = [j for _, j in part]
            want.add((i, part[0], part[-1] + 1))
    assert {tuple(r) for r in queries.p2_spans(spark, data).collect()} == want


def test_groups_of_near_copies(spark, data):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(99, 50), (60, 50), (60, 99), (70, 80)], "a long, b long")
    assert {tuple(r) for r in p7_near.components(edges).collect()} == {(k, 0) for k in range(1, 31)} | {(99, 50), (60, 50), (80, 70)}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in ((r.id_a, r.id_b) for r in queries.p7_found(spark, data).collect()):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    groups = {r.id: r.group_id for r in queries.p7_groups(spark, data).collect()}
    assert groups == {i: find(i) for i in groups} and len(set(groups.values())) < len(groups)
