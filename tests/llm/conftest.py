from __future__ import annotations

import pytest
from pyspark.sql import types as T

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, under names a caller may have as well.
CLASHING = "row string, kept boolean, key binary, version long, bucket long, term string, score double"

MEADOW = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old green tree near our house"


def documents(spark, texts, clashing=True):
    """A table of documents, ids counted from 1; a pair (id, text) gives the id itself."""
    rows = []
    for i, t in enumerate(texts, 1):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en", "src", None) + (("x", None, b"k", 7, 1, "t", 0.5) if clashing else ()))
    return spark.createDataFrame(rows, FIELDS + (", " + CLASHING if clashing else ""))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one-word, very long, repeated, special and non-ASCII texts."""
    return [
        None,
        "",
        " \t\n ",
        "one",
        MEADOW,
        MEADOW,
        MEADOW.upper(),
        (5, MEADOW),  # a repeated row
        (None, MEADOW),
        (None, None),
        "x" * 60_000,
        "word " * 30_000,
        "a  b\n\n c \r\n\td   e",
        "don't <|endoftext|> we've <|startoftext|> 1234,5!!",
        "naïve Ünïcödé İstanbul ΑΣ 日本語　text é \U0001f600 \x85 a\x1cb",
        "Released under the MIT Licence. Apache License, then General  Public\nLicense; apache license",
        "\n\n\n" + MEADOW + "\n" + MEADOW + "\n",
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return documents(spark, odd_texts).persist()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], T._parse_datatype_string("doc_id long, quality int, toxic int"))
