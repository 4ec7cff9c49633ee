from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lettermill.functions import scores, sql, text
from lettermill.operators import model
from lettermill.streaming import milter


def test_sql_functions_equal_columns(spark):
    names = sql.register(spark)
    df = spark.createDataFrame([("see https://a.hu/x joe@x.hu www.abc.info 'q' \"w\"\n\n-----old",), ("e-mail 12a!!;..",), ("",), (None,)], "t string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT mail_redact(t) AS a, mail_squeeze(t) AS b, mail_own_text(t) AS c, mail_lex(t) AS d FROM texts").collect()
    want = df.select(text.redact(F.col("t")).alias("a"), text.squeeze(F.col("t")).alias("b"), text.cut_reply(F.col("t")).alias("c"), text.lex(F.col("t")).alias("d")).collect()
    assert got == want and len(names) == 7
    rows = spark.createDataFrame([(s / 4 - 0.1, k) for s in range(0, 404) for k in (5, 50)], "s double, k int")
    rows.createOrReplaceTempView("scored")
    assert spark.sql("SELECT mail_bucket(s, k) AS b FROM scored").collect() == rows.select(scores.online_bucket(F.col("s"), F.col("k")).alias("b")).collect()
    assert tuple(spark.sql("SELECT mail_points('80spam'), mail_points('dunno'), mail_log_line(7, array('a', 'b'))").first()) == (2, None, "  7%:a b")


def test_weights_round_trip(spark, tmp_path):
    w = model.random_weights(np.ones((3, 4)))
    model.save_weights(spark, w, str(tmp_path / "w"))
    back = model.load_weights(spark, str(tmp_path / "w"))
    assert back.keys() == w.keys() and all((back[k] == w[k]).all() for k in w)


def test_logged_headers(spark):
    rows = spark.createDataFrame([("c", 0, "L", b"From\0a\0"), ("c", 1, "L", b"To\0b\0"), ("c", 2, "B", b"From")], milter.FRAME)
    assert [tuple(r) for r in milter.logged_headers(rows).collect()] == [("c", 0, "From", "a")]
