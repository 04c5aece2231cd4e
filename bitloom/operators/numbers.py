"""The number check of the gate: one Arrow-fed pass per document, lines compared by number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.numbers import check_line
from .gate import FAIL, PASS, WARN


def check_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, status, missing, extra (``L3:12`` labels, comma-joined) of documents with src and tgt lines.

    A missing number fails; digits that no source number accounts for warn, strict or not. A target
    that ends early has empty lines from there on.
    """

    def judge(src, tgt) -> tuple[str, str, str]:
        missing, extra = [], []
        for i, s in enumerate([] if src is None else src):
            lack, more = check_line(s, tgt[i] if tgt is not None and i < len(tgt) else "")
            missing += [f"L{i + 1}:{x}" for x in lack]
            extra += [f"L{i + 1}:{x}" for x in more]
        return FAIL if missing else WARN if extra else PASS, ",".join(missing), ",".join(extra)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, *judge(s, t)) for d, s, t in zip(f["doc_id"], f["src"], f["tgt"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "status", "missing", "extra"])

    return docs.select("doc_id", "src", "tgt").mapInPandas(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, status string, missing string, extra string")
