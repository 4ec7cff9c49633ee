"""The text and verdict functions as temporary SQL functions, which Catalyst expands like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import scores, text


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _chain(value: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        value = f"regexp_replace({value}, {_raw(pattern)}, '{to}')"
    return value


def register(spark: SparkSession) -> list[str]:
    """Create mail_redact, mail_squeeze, mail_own_text, mail_lex, mail_bucket, mail_points and mail_log_line; gives their names."""
    points = " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.POINTS.items())
    bucket = f"CASE WHEN known < {scores.LEAST_KNOWN} THEN 'toosmall' WHEN s + 0.1D < 2 THEN 'ham' WHEN s + 0.1D < 10 THEN 'maybeham' WHEN s + 0.1D < 20 THEN '20ham' WHEN s + 0.1D > 98 THEN 'spam' WHEN s + 0.1D > 90 THEN 'maybespam' WHEN s + 0.1D > 80 THEN '80spam' ELSE 'dunno' END"
    functions = {
        "mail_redact": ("t STRING", "STRING", _chain("t", [(text.URL, "httpurl"), (text.EMAIL, "emailaddress"), (text.DOMAIN, "domainname")])),
        "mail_squeeze": ("t STRING", "STRING", f"trim({_chain('t', [('[' + text.SPACES + chr(34) + ']+', ' ')])})"),
        "mail_own_text": ("t STRING", "STRING", _chain("t", [(text.REPLY, "")])),
        "mail_lex": ("t STRING", "ARRAY<STRING>", f"filter(split({_chain('t', text.LEXER)}, ' '), x -> x <> '')"),
        "mail_bucket": ("s DOUBLE, known INT", "STRING", bucket),
        "mail_points": ("bucket STRING", "INT", f"CASE lower(bucket) {points} END"),
        "mail_log_line": ("s INT, tokens ARRAY<STRING>", "STRING", "concat(lpad(cast(s AS STRING), 3, ' '), '%:', array_join(tokens, ' '))"),
    }
    for name, (args, result, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(functions)
