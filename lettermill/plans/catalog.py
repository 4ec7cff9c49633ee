"""The library's queries by name over a data folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.html import cut_head, html_to_text, is_html
from ..operators import addresses, compare, corpus, model
from ..sources import mbox, mime
from ..sources.lines import pass_directives
from ..storage import spread
from ..streaming import milter
from . import oracle


#: Rows of an embedding matrix that every task may hold.
MATRIX_ROWS = 200_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over all cores; a small file would otherwise be one task."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "ctype"))


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row of each line of the score log."""
    return _table(spark, sf_dir, "score_log").select("line_no", *columns).distinct()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real-valued score from the logged one, and the number of tokens."""
    rows = _lines(spark, sf_dir, "score", "tokens").where("score is not null and tokens is not null")
    return rows.select("line_no", (F.col("score") + (F.col("line_no") % 7) * 0.125).alias("raw"), F.size("tokens").alias("known"))


def _rescored(rows: DataFrame) -> DataFrame:
    """Lines with the score of a second, deterministic scorer, compared with the logged one."""
    other = (F.aggregate(F.transform("tokens", F.length), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) * 37 + F.size("tokens") * 11) % 101
    return compare.compared(rows.withColumn("new", other.cast("int")), "score", "new")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged score against that of a second scorer."""
    return _rescored(_lines(spark, sf_dir, "score", "tokens").where("score is not null and tokens is not null"))


def _documents_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokenized(_docs(spark, sf_dir).where("text is not null").select("doc_id", "lang", "text"), "text").drop("text")


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.redact(F.col("text")).alias("redacted"))


def redaction_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = _docs(spark, sf_dir).select("lang", text.redact(F.col("text")).alias("t"))
    count = lambda word: F.sum(F.coalesce(F.size(F.split("t", word, -1)) - 1, F.lit(0))).alias(word)
    return red.where("t is not null").groupBy("lang").agg(count("httpurl"), count("emailaddress"), count("domainname"))


def entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.decode_entities(F.col("text")).alias("decoded"))


def numeric_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.decode_numeric(F.col("text")).alias("decoded"))


def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.fold(F.col("text")).alias("folded"))


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_tokens(spark, sf_dir).select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


def token_totals_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_tokens(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(is_html(F.coalesce("text", F.lit("")), F.coalesce(F.trim(F.substring_index("ctype", ";", 1)), F.lit(""))))
    return html_to_text(docs.withColumn("text", cut_head(F.col("text"))), "doc_id", "text").select(F.col("id").alias("doc_id"), "text")


def html_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text(spark, sf_dir)
    return rows.agg(*[F.sum(F.when(F.contains(F.col("text"), F.lit(m)), 1).otherwise(0)).alias(n) for n, m in (("comments", "HTMLcomment"), ("white", "HTMLhiddenWHITE:"), ("tiny", "HTMLhiddenFONTSIZE:"))])


def squeeze_and_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", text.squeeze(F.col("text")).alias("squeezed"))
    return rows.where(text.usable(F.col("squeezed")))


def reply_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.cut_reply(F.col("text")).alias("own"))


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("doc_id", text.cut_reply(F.col("text")).alias("own")).where("length(own) > 100")
    words = own.select("doc_id", F.size(text.counted_words(F.col("own"))).alias("counted"), F.size(F.filter(F.split(text.squeeze(F.col("own")), " "), lambda w: w != "")).alias("words"))
    return words.where("counted >= 20 and words >= 30")


def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.vocabulary(_documents_tokens(spark, sf_dir), "tokens", 2)


def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab_counts(spark, sf_dir).orderBy(F.desc("n"), "token").limit(100)


def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.coverage(_table(spark, sf_dir, "mail_corpus").select("tokens"), "tokens", _table(spark, sf_dir, "vocab"))


def encode_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.known_tokens(_documents_tokens(spark, sf_dir), "doc_id", "tokens", _table(spark, sf_dir, "vocab"))
    return known.select("doc_id", F.array_join("tokens", " ").alias("known"), F.array_join(corpus.padded(F.col("ids")).cast("array<string>"), " ").alias("ids"))


def minimum_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.known_tokens(_documents_tokens(spark, sf_dir), "doc_id", "tokens", _table(spark, sf_dir, "vocab"))
    return known.where(F.size("tokens") >= scores.LEAST_KNOWN).select("doc_id", F.size("tokens").alias("known"))


def best_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "mime_parts").where("lower(ctype) like 'text/%'").select("msg_no", "part_no", F.length("payload").alias("size")).distinct()
    return corpus.best_candidate(parts, "msg_no", "part_no", "size")


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_of_each(_docs(spark, sf_dir).where("text is not null").select("doc_id", "text"), "text", "doc_id").select("doc_id")


def _dedup_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_tokens(spark, sf_dir).where("size(tokens) >= 20").select("doc_id", "tokens")


def near_dedup_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.near_dedup(_dedup_input(spark, sf_dir), "doc_id", "tokens")


def near_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.near_dedup_greedy(_dedup_input(spark, sf_dir), "doc_id", "tokens")


def label_union_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = _table(spark, sf_dir, "mail_corpus").select("id", "tokens", "src_file").distinct()
    part = lambda name: mail.where(F.col("src_file") == name).select("id", "tokens")
    rows = corpus.labelled_union(part("mail.neg"), part("mail.pos"), part("mail.negT"), part("mail.posT"))
    hot = corpus.one_hot(F.col("label"))
    return rows.select("id", "split", "label", hot[0].alias("spam"), hot[1].alias("ham"), F.size("tokens").alias("n"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = _table(spark, sf_dir, "mail_corpus").select("id", "label", "split").distinct()
    return mail.groupBy("split", "label").agg(F.count("*").alias("n"))


def verdict_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("line_no", scores.online_verdict(F.col("raw"), F.col("known")).alias("verdict"))


def verdict_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("line_no", scores.batch_verdict(F.col("raw"), F.col("known")).alias("verdict"))


def verdict_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("line_no", scores.online_bucket(F.col("raw"), F.col("known")).alias("bucket"))
    return scores.with_points(rows, "bucket").select("line_no", "bucket", "points")


def routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_batch(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


def percent_of_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir, "score").where("score is not null")
    return rows.select("line_no", scores.percent(F.col("score").cast("double"), (F.col("line_no") % 5).cast("double") * 20).alias("pct"))


def score_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).select("line_no", "score", "new", "diff", "change")


def score_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.counters(_changed(spark, sf_dir))


def score_running_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.running(_changed(spark, sf_dir), "line_no").select("line_no", "total", "changed", "crossed", "changed_pct", "crossed_pct")


def large_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.large_changes(_changed(spark, sf_dir), "tokens").select("line_no", "score", "new", "text")


def score_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir, "score", "tokens").where("score is not null and size(tokens) > 0")
    line = rows.select("line_no", scores.log_line(F.col("score"), F.col("tokens")).alias("line"))
    back = line.withColumn("l", scores.parse_log_line(F.col("line")))
    return back.select("line_no", "line", F.col("l.score").alias("score"), F.size("l.tokens").alias("n"))


def directive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", pass_directives(F.col("line"), text.tokenize(F.col("line"))).alias("out"))


def mbox_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return corpus.file_boundaries(lines, "doc_id", "pos", "line").groupBy("doc_id").agg(F.max("msg_no").cast("long").alias("messages"), F.count("*").alias("lines"))


def charset_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "mime_parts").select("msg_no", "part_no", "charset").distinct()
    return parts.select("msg_no", "part_no", mime.repaired_charset(F.col("charset")).alias("charset"))


def mime_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mime.candidates(_table(spark, sf_dir, "mime_parts"))


def attachment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "mime_parts").select("msg_no", "part_no", "ctype", "fname").distinct()
    return parts.select("msg_no", "part_no", mime.attachment_kind(F.col("ctype"), F.col("fname")).alias("kind")).where("kind is not null")


def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "header_block").where("name is not null").select("msg_no", "seq", F.lower(F.trim("name")).alias("hdr")).distinct()
    return rows.groupBy("hdr").agg(F.count("*").alias("n"), F.sum(F.when(F.col("hdr").isin(addresses.FIELDS), 1).otherwise(0)).alias("with_addresses"))


def header_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.addresses(_table(spark, sf_dir, "header_block"))


def address_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.address_book(header_addresses(spark, sf_dir))


def address_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.events(header_addresses(spark, sf_dir))


def _matrix(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The whole embedding matrix: a model of fixed size, and not a table that grows with the mail; one too large to be sent is an error."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = rows.count()
    if n > MATRIX_ROWS:
        raise ValueError(f"an embedding matrix of {n} rows is too large to be sent to every task")
    return np.array([r[1] for r in rows.orderBy("vec_id").collect()], np.float32)


def cnn_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = corpus.known_tokens(_documents_tokens(spark, sf_dir), "doc_id", "tokens", _table(spark, sf_dir, "vocab"))
    rows = known.select("doc_id", corpus.padded(F.col("ids")).alias("ids"))
    return model.score(rows, "ids", model.random_weights(_matrix(spark, sf_dir))).select("doc_id", "score")


def linear_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = _table(spark, sf_dir, "mail_corpus").where("tokens is not null and label is not null").select("id", F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"), F.col("label").cast("double").alias("label"), "split").dropDuplicates(["id", "split"])
    fitted = model.train_linear(mail.where("split = 'train'"), "tokens", "label")
    return model.evaluate(fitted.transform(mail.where("split = 'validation'")), "label")


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "header_block").where("name is not null").select("msg_no", "seq", "name", F.coalesce("value", F.lit("")).alias("value")).dropDuplicates(["msg_no", "seq"])


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each message: MailFrom, its headers, EndHeaders, its parts as body chunks in order, EndBody."""
    heads = _heads(spark, sf_dir)
    parts = _table(spark, sf_dir, "mime_parts").where("msg_no is not null").select("msg_no", "part_no", "payload").dropDuplicates(["msg_no", "part_no"])
    every = heads.select("msg_no").unionByName(parts.select("msg_no")).distinct()
    conn = F.concat(F.lit("c"), F.col("msg_no").cast("string")).alias("conn_id")
    row = lambda df, seq, cmd, payload: df.select(conn, seq.cast("long").alias("seq"), F.lit(cmd).alias("cmd"), payload.cast("binary").alias("payload"))
    out = row(every, F.lit(0), "M", F.lit(b"<a@b.example>\0"))
    out = out.unionByName(row(heads, F.col("seq") + 1, "L", F.concat(F.encode("name", "UTF-8"), F.lit(b"\0"), F.encode("value", "UTF-8"), F.lit(b"\0"))))
    out = out.unionByName(row(every, F.lit(1_000_000), "N", F.lit(b""))).unionByName(row(parts, F.col("part_no") + 1_000_001, "B", F.coalesce("payload", F.lit(b""))))
    return out.unionByName(row(every, F.lit(1 << 40), "E", F.lit(b"")))


def mail_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milter.assembled_batch(_frames(spark, sf_dir)).select("conn_id", F.length("raw").cast("long").alias("bytes"), "size", F.md5(F.hex("raw").cast("binary")).alias("md5"), F.col("grey_reject").alias("grey"))


def milter_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and envelope addresses as the parsers give them, read as UTF-8."""
    rows = milter.parsed(_frames(spark, sf_dir).where("cmd in ('L', 'M')"))
    utf8 = lambda x: F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")
    return rows.select("conn_id", "seq", "name", utf8(F.get("args", F.lit(0))).alias("first"), utf8(F.try_element_at("args", F.lit(2))).alias("second"))


def milter_negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negotiation and capabilities, with the number of a log line as the bits that are offered."""
    rows = _lines(spark, sf_dir).withColumns({"can": F.col("line_no").bitwiseAND(F.lit(63)), "skip": F.col("line_no").bitwiseAND(F.lit(127))})
    act = F.element_at(F.array(*[F.lit(a) for a in ("AddHeader", "ChangeBody", "AddRecipient", "DeleteRecipient", "ChangeHeader", "Quarantine", "Accept")]), (F.col("line_no") % 7 + 1).cast("int"))
    return rows.withColumn("n", milter.negotiated(F.col("can"), F.col("skip"), 17, milter.skipped(["MailFrom", "Header", "Body"]))).select("line_no", "n.*", act.alias("action"), milter.allowed(act, F.col("can")).alias("ok"))


def milter_header_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    utf8 = lambda x: F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")
    return milter.logged_headers(_frames(spark, sf_dir)).select("conn_id", "seq", "header", utf8(F.col("value")).alias("value"))


def milter_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actions at the end of each scored message."""
    listed = verdict_online(spark, sf_dir).select("line_no", F.posexplode(milter.actions(F.col("verdict"))).alias("pos", "a"))
    return listed.select("line_no", "pos", "a.action", F.col("a.name").alias("header"), "a.value")


def canonical_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _heads(spark, sf_dir).where("lower(trim(name)) = 'from'")
    return heads.select("msg_no", "seq", milter.canonical(F.regexp_extract("value", r"(<[^<>]*>)", 1)).alias("addr"))


def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines as they come out of whole raw messages; values in which a blank line would end the headers are left out."""
    lines = _heads(spark, sf_dir).where(~F.col("name").rlike(r"[\s:]") & (F.trim("name") != "") & F.col("value").rlike(r"^[^\r\n]*\S[^\r\n]*$"))
    line = F.concat("name", F.lit(": "), F.regexp_replace("value", r"^[ \t]+|[ \t]+$", ""))
    raw = lines.groupBy("msg_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).getField("line"), "\n").alias("head"))
    messages = raw.select("msg_no", F.encode(F.concat(F.lit("From x\n"), "head", F.lit("\n\nbody: none\n")), "UTF-8").alias("raw"))
    return mbox.header_lines(messages).groupBy("msg_no", "name", "value").agg(F.count("*").alias("n"))


def parts_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as they come out of whole messages that are put together from them."""
    parts = _table(spark, sf_dir, "mime_parts").where("msg_no is not null").select("msg_no", "part_no", "ctype", "payload").dropDuplicates(["msg_no", "part_no"])
    return mime.read_parts(mime.composed(parts)).select("msg_no", (F.col("part_no") - 1).alias("part_no"), "ctype", F.md5(F.hex("payload").cast("binary")).alias("md5"))


def rtf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as RTF and read again."""
    return mime.read_as(_docs(spark, sf_dir).where("text is not null").select("doc_id", mime.to_rtf(F.col("text")).alias("payload")), "rtf")


def docx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents written as paragraphs of a DOCX and read again."""
    return mime.read_as(mime.to_docx(_docs(spark, sf_dir).where("text is not null").select("doc_id", "text")), "docx")


def score_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of two scorers over the lines that count: no ignored ones, and each text once."""
    lines = compare.comparable(_lines(spark, sf_dir, "score", "tokens").where("score is not null and tokens is not null"), "tokens", "line_no")
    return compare.counters(_rescored(lines))


def result_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the validation dump, with a logged score in place of a model's."""
    rows = _lines(spark, sf_dir, "score", "tokens").where("score is not null and tokens is not null")
    return rows.select("line_no", model.result_line(F.col("score").cast("double"), F.col("line_no") % 2, F.col("line_no") % 100, F.lit(100), F.array_join("tokens", " ")).alias("line"))


def milter_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milter.activity(_frames(spark, sf_dir))


def milter_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).groupBy("cmd").agg(F.count("*").alias("n")).withColumn("reply", milter.reply(F.col("cmd")))


def shuffled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shuffled(_table(spark, sf_dir, "mail_corpus").where("split = 'train' and id is not null").select("id").distinct(), "id", 7)


_QUERIES = (
    redact_text, redaction_counts_by_lang, entity_decode, numeric_entities, fold_accents, tokenize_docs, token_totals_by_lang, html_text, html_flag_counts, squeeze_and_gate,
    reply_truncate, corpus_words, vocab_counts, vocab_topk, vocab_coverage, encode_sequence, minimum_evidence, best_part, exact_dedup, near_dedup_relational, near_dedup_greedy,
    label_union_onehot, split_counts, verdict_online, verdict_batch, verdict_points, routed_counts, percent_of_outputs, score_compare, score_counters, score_running_error,
    large_changes, score_log_round_trip, directive_lines, mbox_split, charset_repair, mime_candidates, attachment_kinds, header_names, header_addresses, address_book, address_events,
    cnn_score, linear_evaluation, mail_assembly, milter_activity, milter_replies, shuffled_ids, milter_parsed, milter_negotiation, milter_header_log, milter_actions,
    canonical_addresses, header_scan, parts_walk, rtf_text, docx_text, score_regression, result_dump,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.queries()
