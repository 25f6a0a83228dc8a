"""Small tables with the odd cases that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


LONG = "\n".join(prose(k, 40) for k in range(400))


def odd_documents(spark, extra=False):
    """Null text, null source, null id, empty and blank texts, a very long one, repeats, equal texts, other scripts."""
    a, b = prose(1, 80), prose(2, 60)
    rows = [
        (0, a, "en", "s1", 1), (1, a, "en", "s1", 1), (2, b, "en", "s2", 1), (3, None, None, None, None), (4, "", "en", "s1", 0), (5, " \n\t \n", "en", None, 5), (6, LONG, "en", "s2", 9),
        (7, "日本語 のテキスト 😀", "ja", "é", 3), (8, "x", "en", "s1", 1), (9, b, "en", "s2", 1), (9, b, "en", "s2", 1), (None, a, "en", "s1", 1), (None, None, None, None, None), (12, a + " tail", "en", "s3", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("score", "shard", "slot", "size", "a", "b", "node", "path", "host", "bucket", "words", "rank", "text_hash", "gone", "keeper", "codes", "bands", "label", "next"):
            df = df.selectExpr("*", f"'odd' AS `{name}`")
    return df, rows


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
