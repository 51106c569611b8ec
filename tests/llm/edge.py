"""Tables that every operator must take: nulls, empty and long texts, ties, repeats, clashing names, no rows."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, print string, size int, copies string, sid long, row string, found int, _t string"
EXTRA = (0.5, "p", 3, "c", 4, "r", 5, "t")


def rows() -> list[tuple]:
    long = "the house is on the hill and the river runs by it " * 4000
    base = [
        (1, "the cat sat on the mat and the dog ran by", "en", "a", 41),
        (1, "the cat sat on the mat and the dog ran by", "en", "a", 41),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (None, "der hund und die katze sind im haus", "de", None, 35),
        (None, None, None, None, None),
        (4, long, "en", "b", len(long)),
        (5, " \t\n", "fr", "b", 3),
        (6, "ÀÉ ß   \U0001f600 naïve", "fr", "", 12),
        (7, "the cat sat on the mat and the dog ran by", "en", "b", 41),
        (8, "12 34 !!", None, "a", 8),
    ]
    return [(*r, *EXTRA) for r in base]


def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
