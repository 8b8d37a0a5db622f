"""Small documents with the hard cases: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for results or on the way.
CLASH = ["k1", "k2", "_text", "_row", "first", "last", "kept", "size", "taken", "target", "score", "ids", "n_tokens", "simhash", "cell", "order_minhash", "ID", "_h", "_g", "h", "g", "f", "k", "root", "wide", "shingles", "toxicity", "_toxicity", "_group", "_added", "_head", "_serves", "_times", "next_text", "lang_pred", "half", "y", "t"]


def documents(spark, n=120):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "été", "the", "of", "and", "x1", "löwe"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, ""]), None) for i in range(n)]
    long = " ".join(rng.choices(words, k=20_000))
    rows += [(900, long, "en", "a", 1), (901, "y" * 60_000, None, "b", 2), (902, None, None, None, None), (903, "", "en", "a", 0), (None, "no id here", "en", "a", 1), (None, None, None, None, None)]
    rows += [rows[5], rows[5], (904, rows[6][1], "fr", "b", 3), (905, " \t\r\n ", "fr", "b", 3), (906, "日本語 😀 <|endoftext|> naïve space", "fr", "c", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def unclashed(df, new=()):
    """All clashing columns that the operator does not return itself are as they were."""
    low = {x.lower() for x in new}
    for c in CLASH:
        if c.lower() not in low:
            assert df.where(f"`{c}` <> 'own {c}'").count() == 0
