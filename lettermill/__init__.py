"""Mail-text analytics on Spark: parse, redact, tokenise, de-duplicate, encode and score mail at scale."""
