import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, copies, ties, control strings and clashing extra columns."""
    rows = [
        (1, None, "en", "a", 1), (2, "", "en", None, 2), (3, "one two three", None, "a", None),
        (4, LONG, "en", "b", 4), (5, LONG, "en", "c", 5), (6, "  \n\t ", "en", "a", 6),
        (7, "One two\nthree", "en", "b", 7), (8, "Ünï cödé ﬀ 漢字 words here and there \x00 and on", "xx", "c", 8),
        (9, "same line of words\nown text of nine", "en", "a", 9), (10, "same line of words\nown text of ten", "en", "b", 1),
        (11, " same line of words \nown text of eleven", "en", "c", 1), (12, "same line of words", "en", "d", 1),
        (13, "<|im_end|><|endoftext|> \\ back", "en", "d", 1), (14, "one  two   three    ", "en", "a", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    extra = {c: frame["n_chars"] for c in ("u", "v", "n", "token", "doc", "part", "key", "size", "line", "_row", "length")}
    return frame.withColumns(extra)


@pytest.fixture(scope="session")
def folder_rows(spark, folder):
    """Rows of a table of the smallest folder."""
    held = {}

    def rows(name, *columns):
        if name not in held:
            held[name] = spark.read.parquet(f"{folder}/{name}.parquet").collect()
        return [tuple(r[c] for c in columns) for r in held[name]]

    return rows
