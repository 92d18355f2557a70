"""Small hard tables for the operators of ``cytomill.llm``."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_words long"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioust nrlmdé")[0] for _ in range(rng.randint(2, 8))).replace(" ", "x") for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Null in every column, empty, blank and very long texts, ties, repeated rows; clashing extra columns."""
    long = prose(5, 30_000)
    passage = prose(6, 60)
    rows = [
        (0, "", "en", "a"), (1, None, "en", "a"), (2, " \t\n ", "de", None), (3, "one two", None, "b"), (4, "one TWO", "en", "b"),
        (5, prose(1, 200), "en", "a"), (6, prose(1, 200), "en", "a"), (6, prose(1, 200), "en", "a"), (7, prose(1, 200).upper(), "en", "c"),
        (8, prose(1, 199) + " changed", "en", "a"), (9, long, "fr", "a"), (10, prose(2, 90) + "\n" + passage + "\n" + prose(3, 40), "en", "a"),
        (11, prose(4, 50) + " " + passage, "es", "a"), (12, "the same line\nthe same line\nthe same line\n" * 20, "en", "a"),
        (13, "### $$$ %%% *** |||\n" * 30, "en", "a"), (14, "näive <|endoftext|> ΑΣ İ it's 12  x", "en", "a"), (15, "?!", "en", "a"),
        (None, prose(8, 80), "en", "a"), (None, None, None, None), (16, "x" * 5000, "en", "a"), (17, "a b c d e", "en", "a"), (18, "a  b\tc d E", "en", "a"),
    ]
    return [(*r, len(r[1] or ""), 0.5, True, 7) for r in rows]


def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
