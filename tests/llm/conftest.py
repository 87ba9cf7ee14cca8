import sys
from pathlib import Path

import pytest

for folder in (Path(__file__).resolve().parents[2], Path(__file__).resolve().parents[1]):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows."""

    def rows(items, extra=""):
        full = [(i[0], i[1], None, i[2] if len(i) > 2 else f"s{n % 3}", None if i[1] is None else len(i[1])) for n, i in enumerate(items)]
        df = spark.createDataFrame(full, COLUMNS)
        return df.selectExpr("*", *extra) if extra else df

    return rows


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and runs far away from the old house by the river in the night"
    return [
        (1, plain), (1, plain), (2, plain), (3, None), (4, ""), (5, " \n\t "), (None, plain), (None, None), (6, long), (7, long + " more"),
        (8, "one"), (9, "é ü 漢字 " * 40), (10, "\x1f  odd\xa0space\r\nline " * 12), (11, "a\n" * 500),
    ]

