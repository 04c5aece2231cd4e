"""Fill-in-middle transformation: texts cut at two seeded places and laid out prefix-suffix-middle or suffix-prefix-middle.

A unit is a word with the white space before it, or what white space is left at the end. Each Arrow batch is one
kernel over the UTF-8 buffer: a byte-class table, a mask of bytes after which a unit ends (a word byte beside white
space, or the end of a text), its cumulative sum, reset at each text by subtracting the sum at its start, and one
``searchsorted`` that turns the wanted unit numbers of all rows into byte places. The output bytes are gathered
likewise. Seeds come from SHA-256 in the JVM, and :func:`restored` rebuilds the texts with built-in functions.

Scale: one narrow pass, no shuffle; work memory is some thirty bytes for each byte of a 2 MB slice, and a text longer
than that goes through in windows of the same size, so only its own bytes are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import flat_text, pieces, tidy

MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
WINDOW = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord(x) for x in MARKS]] = True


def unit_ends(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True at each byte after which a unit of some text ends."""
    word = ~SPACE[data]
    ends = np.zeros(len(data), bool)
    np.logical_and(word[:-1], ~word[1:], out=ends[:-1])
    if len(data):
        last = off[1:][np.diff(off) > 0] - 1
        ends[off[(off > 0) & (off < len(data))] - 1] = True
        ends[last] = True
    return ends


def unit_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The running number of unit ends, its value before each text, and each text's units."""
    total = np.cumsum(unit_ends(data, off), dtype=np.int32)
    at = np.concatenate(([0], total))[off].astype(np.int64)
    return total, at[:-1], np.diff(at)


def places(total: np.ndarray, before: np.ndarray, off: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte after the given number of units of each text."""
    found = np.searchsorted(total, (before + units).astype(total.dtype), side="left") + 1
    return np.where(units > 0, found, off[:-1])


def marked(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True for each text that holds one of the marks."""
    out = np.zeros(len(off) - 1, bool)
    if len(data) >= 3:
        at = np.flatnonzero((data[:-2] == 60) & _LETTER[data[1:-1]] & (data[2:] == 62))
        row = np.searchsorted(off, at, side="right")
        out[row[row == np.searchsorted(off, at + 2, side="right")] - 1] = True
    return out


def characters(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    return (lead[stop] - lead[start]).astype(np.int64)


def _forms(n: np.ndarray, seeds: np.ndarray, plain: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower and the higher cut, and the form (0 plain, 1 spm, 2 psm) of each text."""
    a, b = seeds[0] % (n + 1), seeds[1] % (n + 1)
    form = np.where(plain | (seeds[2] % 100 >= rate), 0, np.where(seeds[3] % 100 < spm, 1, 2))
    return np.minimum(a, b), np.maximum(a, b), form


NAMES = np.array(["plain", "spm", "psm"])
FIELDS = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _batch(text: pa.Array, seeds: np.ndarray, rate: int, spm: int) -> list[pa.Array]:
    """All rows of one slice together."""
    data, off = flat_text(text)
    total, before, n = unit_counts(data, off)
    lo, hi, form = _forms(n, seeds, marked(data, off) | (np.diff(off) == 0), rate, spm)
    a, b = places(total, before, off, lo), places(total, before, off, hi)
    start, end, size = off[:-1], off[1:], len(data)
    mark = {x: (np.full(len(n), size + 3 * i), np.full(len(n), size + 3 * i + 3)) for i, x in enumerate(MARKS)}
    none = (start, start)
    prefix, middle, suffix = (start, a), (a, b), (b, end)
    layout = {0: [(start, end)] + [none] * 5, 1: [mark["S"], suffix, mark["P"], prefix, mark["M"], middle], 2: [mark["P"], prefix, mark["S"], suffix, mark["M"], middle]}
    parts = [np.choose(form, [np.stack(layout[f][k]) for f in (0, 1, 2)]) for k in range(6)]
    begin = np.stack([p[0] for p in parts], axis=1).ravel()
    length = np.stack([p[1] - p[0] for p in parts], axis=1).ravel()
    stop = np.cumsum(length)
    source = np.concatenate([data, np.frombuffer(b"".join(MARKS.values()), np.uint8)])
    out = source[np.repeat(begin - (stop - length), length) + np.arange(int(stop[-1]) if len(stop) else 0)]
    offsets = np.concatenate(([0], stop[5::6])).astype(np.int32)
    plain = form == 0
    return [
        pa.array(n), pa.array(NAMES[form]), pa.array(characters(data, start, a), mask=plain), pa.array(characters(data, a, b), mask=plain),
        pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(out)]),
    ]


def _long(text: pa.Array, seeds: np.ndarray, rate: int, spm: int) -> list[pa.Array]:
    """The same for one text of more than a window, window by window."""
    data, _ = flat_text(text)
    size = len(data)

    def window(k: int) -> np.ndarray:
        to = min((k + 1) * WINDOW, size)
        ends = unit_ends(data[k * WINDOW : to], np.array([0, to - k * WINDOW]))
        if to < size:  # the last byte ends a unit only beside white space
            ends[-1] = not SPACE[data[to - 1]] and SPACE[data[to]]
        return ends

    sums = np.cumsum([int(np.count_nonzero(window(k))) for k in range(-(-size // WINDOW))])
    raw = data.tobytes()
    has = any(m in raw for m in MARKS.values())
    del raw
    lo, hi, form = (int(x[0]) for x in _forms(sums[-1:], seeds, np.array([has]), rate, spm))

    def place(units: int) -> int:
        if units == 0:
            return 0
        k = int(np.searchsorted(sums, units, side="left"))
        return k * WINDOW + int(np.flatnonzero(window(k))[units - (int(sums[k - 1]) if k else 0) - 1]) + 1

    a, b = place(lo), place(hi)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    mark = {x: np.frombuffer(m, np.uint8) for x, m in MARKS.items()}
    layout = [[data], [mark["S"], suffix, mark["P"], prefix, mark["M"], middle], [mark["P"], prefix, mark["S"], suffix, mark["M"], middle]][form]
    out = np.concatenate(layout)
    count = lambda x: int(np.count_nonzero((x & 0xC0) != 0x80))
    none = form == 0
    return [
        pa.array(sums[-1:]), pa.array([str(NAMES[form])]), pa.array([None if none else count(prefix)], pa.int64()), pa.array([None if none else count(middle)], pa.int64()),
        pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(out)], np.int32)), pa.py_buffer(out)]),
    ]


def _transform(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", WINDOW):
                seeds = np.stack([np.asarray(batch.column(2 + i), np.int64) for i in range(4)])
                long = batch.num_rows == 1 and len(flat_text(batch.column(1))[0]) > WINDOW
                columns = (_long if long else _batch)(batch.column(1), seeds, rate, spm)
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *FIELDS.names])

    return tidy(run)


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``id_col``, n, form, prefix_chars, middle_chars, output: one row for each row of ``docs``.

    ``rate`` of 100 texts are cut, ``spm`` of 100 of them with the suffix in front. A text that holds a mark, or is null
    or empty, stays plain (null gives an empty output). A null id is read as an empty one; repeated rows are each
    transformed, alike. Very long texts are transformed whole; an empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    seeds = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.select("id", "text", *seeds).mapInArrow(_transform(rate, spm), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark lies within a part, so each is found by name."""
    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    end = lambda x: F.substring_index(output, x, -1)
    psm = F.concat(between("<P>", "<S>"), end("<M>"), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), end("<M>"), between("<S>", "<P>"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    whole = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS u, sha256('42:' || doc_id::VARCHAR) AS d FROM documents
), seeds AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM units
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM seeds
), parts AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
