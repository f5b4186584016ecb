import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source), with a column of a clashing name."""

    def make(*rows):
        full = [(*row, *("en", "s")[len(row) - 2:], len(row[1] or ""))[:5] for row in rows]
        full = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in full]
        return spark.createDataFrame(full, DOCUMENT).selectExpr("*", "'kept' AS score", "1 AS size", "2 AS node", "3 AS key")

    return make


@pytest.fixture
def odd(documents):
    """Nulls, an empty and a blank text, ties and repeated rows, one very long text."""
    return documents(
        (1, None), (2, ""), (3, " \n\t"), (4, "one two three four five"), (5, "one two three four five"),
        (6, "one two three four five"), (6, "one two three four five"), (None, "no id here at all, sir"), (8, LONG), (9, "¡ÀÉ! Straße 日本語 😀"),
        (10, "word", None, None),
    )
