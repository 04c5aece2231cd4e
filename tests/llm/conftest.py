import pytest

#: Columns whose names clash with what operators add or use inside.
CLASHING = ["fp", "fingerprint", "n_words", "kept", "score", "spans", "items", "digest", "rule", "part", "label"]
LONG = ("word%d " * 3) % (1, 2, 3) * 4000 + "end. token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties and clashing extra columns."""
    texts = [None, "", "  \n\t", "one", "One", LONG, "a b c d e f g h i j k", "a b c d e f g h i j k", "é ñ 你好 \U0001F600 x", "a\x00b", "\x1c \x85   "]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(6, texts[6]), (6, texts[6]), (None, None)]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], schema)


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.where("false")
