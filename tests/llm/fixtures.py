"""Small awkward tables: nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and river stone green house walk slowly under bright morning light with many birds singing near old".split(), "de": "der die und fluss stein haus langsam unter hellem morgen licht mit vielen vögeln nahe alten bäumen schön".split()}


def prose(seed: int, words: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(words)]
    return "\n".join(" ".join(out[k : k + 12]) for k in range(0, len(out), 12))


def awkward(spark: SparkSession) -> DataFrame:
    rows = [(k, prose(k, 60 + k, "en" if k % 2 else "de"), "en" if k % 2 else "de", f"host{k % 3}", 1) for k in range(40)]
    rows += [
        (40, None, None, None, None),
        (41, "", "en", "host0", 0),
        (42, " \t\n ", "en", None, 4),
        (43, "12345 !!! 678", "en", "host1", 13),
        (44, "one", "en", "host1", 3),
        (45, "one two", "de", "host1", 7),
        (46, prose(7, 20_000), "en", "host2", 1),
        (47, "longword" * 20_000, "en", "host2", 1),
        (48, "naïve café \U0001f600 成都 <|endoftext|> it's #1", "en", "host2", 1),
        (None, prose(99, 70), "en", "host0", 1),
        (3, rows[3][1], rows[3][2], rows[3][3], 1),  # a repeated row
        (50, rows[5][1], "en", "host0", 1),  # an exact copy
        (51, rows[5][1].upper(), "en", "host0", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    # columns that operators use inside
    return df.selectExpr("*", "'x' as row_id", "1 as fp", "'y' as body", "2 as rate", "3 as slot", "4 as score")


def empty(spark: SparkSession) -> DataFrame:
    return awkward(spark).limit(0)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, k % 4 and 1, int(k % 5 == 1)) for k in range(40)] + [(40, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark: SparkSession) -> DataFrame:
    rows = [(0, "Quartz lanterns drift across violet harbours while seventeen patient clerks count amber keys before midnight bells."), (1, None), (2, ""), (3, prose(7, 30)), (4, "tiny item")]
    return spark.createDataFrame(rows, "item_id long, text string")
