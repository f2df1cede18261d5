"""Rows that the tests share."""

import random

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
#: Names that operators use inside, as extra columns of their input.
CLASHING = (
    "key hash row okey part node label size start end block slot digest winner copies member score rank n "
    "bucket a b skey chunk pass words seed ids sample kept first rep z _key _hash _digest _of"
).split()


def prose(seed, words):
    r = random.Random(seed)
    syllables = ["the", "an", "er", "ing", "tion", "of", "re", "on", "st", "ea"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(words))


def messy_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd signs."""
    base = prose(1, 80)
    rows = [
        (1, base, "en", "s1", 1), (2, base, "en", "s1", 1), (2, base, "en", "s1", 1), (3, base.replace("an", "zu", 1), None, None, None),
        (4, None, "de", "s2", 0), (5, "", "de", None, 0), (6, " \t\n", "fr", "s2", 3), (None, "no id here at all", "fr", "s3", 1),
        (None, None, None, None, None), (7, prose(2, 30_000), "en", "s1", 1), (8, "x", "es", "s3", 1),
        (9, "nul \x00 sign ▁ and \U0001F600 漢字", "es", "s4", 1), (7, "another text with the id of one before", "de", "s4", 1),
        (10, "a" * 5000, "en", "s2", 1), (11, "café  déjà\x0bvu", "fr", "s3", 1), (12, base + "  ", "en", "s2", 1),
    ]
    return rows
