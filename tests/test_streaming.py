from __future__ import annotations

import struct

from pyspark.sql import functions as F

from lettermill.streaming import milter

FRAMES = [
    ("M", b"<a@b.test>\0"), ("L", b"X-Grey-ng\0REJECT now\0"), ("L", b"From\0a\0"), ("N", b""), ("B", b"body"), ("E", b""),
    ("M", b"<c@d.test>\0"), ("L", b"From\0c\0"), ("A", b""), ("E", b""), ("Q", b""),
]
EXPECTED = [("c", 5, b"X-Grey-ng: REJECT now\nFrom: a\n\nbody", 4, True), ("c", 9, b"", 0, False)]


def _rows():
    return [("c", i, c, p) for i, (c, p) in enumerate(FRAMES)]


def test_batch(spark):
    got = milter.assembled_batch(spark.createDataFrame(_rows(), milter.FRAME)).orderBy("seq").collect()
    assert [(r.conn_id, r.seq, bytes(r.raw), r.size, r.grey_reject) for r in got] == EXPECTED
    assert milter.assembled_batch(spark.createDataFrame([], milter.FRAME)).count() == 0


def test_stream_over_several_batches(spark, tmp_path):
    for k in range(0, len(FRAMES), 3):
        spark.createDataFrame(_rows()[k : k + 3], milter.FRAME).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(milter.FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = milter.assembled(stream).writeStream.format("memory").queryName("mail").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("mail").orderBy("seq").collect()
    assert [(r.conn_id, r.seq, bytes(r.raw), r.size, r.grey_reject) for r in got] == EXPECTED


def test_verdict_stream(spark, tmp_path):
    spark.createDataFrame([("c", 1, b"raw", 3, False)], milter.MESSAGE).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(milter.MESSAGE).parquet(str(tmp_path / "in"))
    query = milter.start_verdicts(stream, lambda b: b.withColumn("verdict", F.lit("ham 0%")), lambda b, n: seen.extend(b.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [a.action for a in seen[0].actions] == ["AddHeader", "Accept", "Continue"] and seen[0].actions[0].value == "ham 0%"


def test_frames_and_parsers(spark):
    wire = b"".join(struct.pack("!I", len(p) + 1) + c.encode() + p for c, p in [("O", struct.pack("!III", 2, 63, 127)), ("C", b"host\x004" + struct.pack("!H", 25) + b"1.2.3.4\0"), ("H", b"me\0"), ("L", b"To\0x\0"), ("D", b"Cj\0mx\0"), ("Z", b"")])
    rows = milter.decode_frames(spark.createDataFrame([("c", wire + b"\0\0\0\x09B"), ("d", None)], "conn_id string, data binary"))
    got = {r.cmd: r for r in milter.parsed(rows).collect()}
    assert got["O"].numbers == [2, 63, 127] and got["C"].args == ["host", "4", "1.2.3.4"] and got["C"].numbers == [25]
    assert got["H"].args == ["me"] and got["L"].args == ["To", "x"] and got["D"].args == ["C", "j", "mx"] and got["Z"].name is None
    assert milter.skipped(["Header", "Body"]) == 127 - 32 - 16
    can = rows.limit(1).select(milter.negotiated(F.lit(63), F.lit(127), 1, 5)).first()[0]
    assert tuple(can) == (2, 1, 5)
    assert milter.encode_action("InsertHeader", "a", "b", 3) == b"i\0\0\0\x03a\0b\0" and milter.encode_action("Accept") == b"a"
    ok = spark.createDataFrame([("AddHeader", 1), ("AddHeader", 2), ("Accept", 0)], "a string, c int").select(milter.allowed(F.col("a"), F.col("c"))).collect()
    assert [r[0] for r in ok] == [True, False, True]
    assert spark.createDataFrame([("<a@b>",), ("<>",)], "a string").select(milter.canonical(F.col("a"))).collect()[0][0] == "a@b"


def test_live_filter(spark, tmp_path):
    import socket
    import time

    from lettermill.streaming import live

    with socket.socket() as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    spool = tmp_path / "spool"
    spool.mkdir()
    stream = live.listen(spark, port=str(port), spool=str(spool), hold="60")
    score = lambda batch: batch.withColumn("verdict", F.concat(F.lit("ham "), F.col("size"), F.lit("%")))
    query = milter.start_verdicts(milter.assembled(stream), score, lambda batch, _: live.answer(batch, str(spool)), str(tmp_path / "cp"), processingTime="0 seconds")
    try:
        for _ in range(600):
            try:
                conn = socket.create_connection(("127.0.0.1", port), timeout=90)
                break
            except OSError:
                time.sleep(0.1)
        with conn, conn.makefile("rb") as back:
            def ask(cmd: bytes, payload: bytes = b"", answers: int = 1) -> list[bytes]:
                conn.sendall(struct.pack("!I", len(payload) + 1) + cmd + payload)
                return [back.read(struct.unpack("!I", back.read(4))[0]) for _ in range(answers)]

            assert ask(b"O", struct.pack("!III", 2, 63, 127)) == [b"O" + struct.pack("!III", 2, 1, 0)]
            ask(b"D", b"Cj\0mx\0", 0)
            assert ask(b"M", b"<a@b.test>\0") == ask(b"L", b"From\0a\0") == ask(b"N") == ask(b"B", b"hello") == [b"c"]
            assert ask(b"E", answers=3) == [b"hX-Mail-Verdict\0ham 5%\0", b"a", b"c"]
            ask(b"Q", answers=0)
        assert not list(spool.iterdir())
    finally:
        query.stop()


def test_replies(spark):
    import pytest

    assert milter.encode_negotiation(63, 127, 1, 5) == b"O" + struct.pack("!III", 2, 1, 5)
    assert milter.encode_actions([("Accept", None, None)]) == b"\0\0\0\1a\0\0\0\1c"
    with pytest.raises(ValueError, match="not negotiated"):
        milter.encode_actions([("ChangeHeader", "a", "b")], can=1)
    df = spark.createDataFrame([("L", None), ("L", "TempFail"), ("B", "PermFail"), ("D", None)], "c string, f string")
    assert [r[0] for r in df.select(milter.reply(F.col("c"), F.col("f"))).collect()] == ["Continue", "TempFail", "Reject", None]
    rows = spark.createDataFrame([("c", 0, "M", b"<a@b.test>\0SIZE=1\0"), ("c", 1, "R", b"<>\0"), ("c", 2, "M", b"")], milter.FRAME)
    assert [r.args for r in milter.parsed(rows).orderBy("seq").collect()] == [["a@b.test", "SIZE=1"], ["<>"], []]
