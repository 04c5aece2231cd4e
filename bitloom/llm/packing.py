"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Documents become ids and an end id; only those longer than a sequence are cut. The pieces are
packed by best-fit decreasing within groups of bounded size. A lower bound for the number of
sequences of each group (dual-feasible functions over its length histogram) certifies the group.
Groups with a gap release the documents of their poorly filled sequences, and every group whose
emptiest sequence isn't full those of its ``release`` emptiest ones; released documents are dealt
into new, fewer groups, where best-fit decreasing runs again. This repeats until one group is left
or nothing is released, so the waste of the partition borders goes as well.

Scale: texts are tokenised where they are read, in one narrow pass; only rows of seven numbers
are shuffled. Rows are dealt by their place in the table, not by their id, so repeated or null ids
spread like all others: a group has about ``group_size`` rows whatever the input, and rounds shrink
geometrically. The driver sees counts only, and for :func:`certificate` the histogram of lengths (at
most ``size`` rows).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import materialize, pieces, tidy

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.for_chunks(path)
        for whole in batches:
            for batch in pieces(whole, "text", 4 << 20):
                ids, off = tokens.with_end(*tokenizer.encode(batch.column(1)), end_id)
                n = np.diff(off)
                count = -(-n // size)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, n[row] - start)
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                at = off[row] + start
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return tidy(run)


def token_pieces(docs: DataFrame, *, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_cut(tokenizer_path or tokens.default_path(), size, end_id), PIECE)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin. Ties keep the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r: some bin has exactly r tokens free
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = mask >> n
        if at:
            room = n + (at & -at).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(histogram: np.ndarray, size: int, max_k: int = 24) -> int:
    """Least number of bins by dual-feasible functions; ``histogram[n]``: items of length n <= size.

    The family f_a (lengths over size - a count as full bins, those under a as nothing) for every
    a up to half, combined with the large items' own bins, and the rounding functions
    u_k(x) = x if (k + 1) x is whole, else floor((k + 1) x) / k, with x = length / size.
    """
    h = histogram.astype(np.int64)
    x = np.arange(len(h), dtype=np.int64)
    total = int((h * x).sum())
    best = -(-total // size)
    count, weight = np.concatenate(([0], np.cumsum(h))), np.concatenate(([0], np.cumsum(h * x)))
    n, half = int(h.sum()), size // 2
    a = np.arange(0, half + 1)
    large = n - count[size - a + 1]  # longer than size - a
    middle = count[size - a + 1] - count[half + 1]  # over half, up to size - a
    middle_weight = weight[size - a + 1] - weight[half + 1]
    small_weight = weight[half + 1] - weight[np.maximum(a, 0)]  # from a to half
    rest = np.maximum(0, small_weight - (middle * size - middle_weight))
    best = max(best, int((large + middle + -(-rest // size)).max()))
    for k in range(1, max_k + 1):
        scaled = (k + 1) * x
        whole = scaled % size == 0
        value = Fraction(int((h * x)[whole].sum()), size) + Fraction(int((h * (scaled // size))[~whole].sum()), k)
        best = max(best, -(-value.numerator // value.denominator))
    return best


def _pack(size: int, last: bool, loose: float, release: int):
    def run(key, table):
        length = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(length, size)
        bound = lower_bound(np.bincount(length, minlength=size + 1), size)
        open_ = np.zeros(len(fill), bool)
        if not last and len(fill):
            if len(fill) > bound:
                open_ = fill < loose * size
            emptiest = np.argsort(fill, kind="stable")[:release]
            open_[emptiest] |= fill[emptiest[0]] < size
        more = {"bin": bins, "offset": offsets, "open": open_[bins], "bins": np.full(len(bins), len(fill)), "bound": np.full(len(bins), bound)}
        for name, values in more.items():
            table = table.append_column(name, pa.array(values))
        return table

    return run


def pack(found: DataFrame, *, size: int = 2048, group_size: int = 50_000, max_rounds: int = 8, loose: float = 0.99, release: int = 16) -> DataFrame:
    """Rows of ``found`` (PIECE columns) with sequence_id, offset and certified.

    Every row gets a place; ties and repeated rows are separate items. An empty table stays empty.
    ``certified``: the row's group, when it was packed for good, used no more sequences than its lower
    bound. False in the last of ``max_rounds`` rounds says that the group may hold a gap.
    """
    done: list[DataFrame] = []
    n = found.count()
    for round_ in range(max_rounds):
        groups = max(1, -(-n // group_size))
        last = groups == 1 or round_ == max_rounds - 1
        # a number of the row itself, so that equal ids and pieces don't meet in one group
        dealt = found.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(groups)))
        schema = f"{PIECE}, part long, bin long, offset long, open boolean, bins long, bound long"
        packed = materialize(dealt.groupBy("part").applyInArrow(_pack(size, last, loose, release), schema), f"packed{round_}")
        number = F.lit(round_ * 2**56) + F.col("part") * F.lit(2**24) + F.col("bin")
        done.append(packed.where("not open").select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
        if last:
            break
        found = packed.where("open").select(*(f.split()[0] for f in PIECE.split(", ")))
        n = found.count()
        if n == 0:
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def certificate(packed: DataFrame, size: int = 2048) -> tuple[int, int]:
    """(sequences used, lower bound for all pieces together)."""
    used = packed.select("sequence_id").distinct().count()
    rows = packed.groupBy("length").count().collect()  # at most ``size`` rows
    h = np.zeros(size + 1, np.int64)
    for r in rows:
        h[r.length] = r["count"]
    return used, lower_bound(h, size)


def pack_documents(docs: DataFrame, *, size: int = 2048, end_id: int = 0, tokenizer_path: str | None = None, group_size: int = 50_000) -> DataFrame:
    """Tokenise, cut and pack ``docs``.

    Null and empty texts are one end id; very long texts are cut into pieces and packed whole; null ids
    and repeated rows are kept, each with a place of its own; texts of equal length (ties) are packed in
    the order they come. An empty table gives no rows. Columns besides the id and the text are
    ignored, whatever their names.
    """
    found = materialize(token_pieces(docs, size=size, end_id=end_id, tokenizer_path=tokenizer_path), "pieces")
    return pack(found, size=size, group_size=group_size)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
