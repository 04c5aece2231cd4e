"""Line clean-up: joining broken lines, blanks, hyphens, batches with context, first mentions.

Input lines are (doc_id, line_no, text). Sequences are gaps-and-islands over a window per document:
flags by ``lag`` or ``lead``, islands by running sums, texts by ordered collection per island.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X


def _doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _running():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(X.split_lines(F.coalesce(F.col(text), F.lit("")))).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line_no"), "text")


def toc_end(lines: DataFrame, body: str = X.CJK_BODY, least: int = 3) -> DataFrame:
    """doc_id, toc_end: lines before the first with ``least`` body characters, and before the blanks above it; 0 without one."""
    n = F.regexp_count("text", F.lit(body))
    first = lines.groupBy("doc_id").agg(F.min(F.when(n >= least, F.col("line_no"))).alias("first"))
    j = lines.join(first, "doc_id")
    above = F.max(F.when((F.col("line_no") < F.col("first")) & ~X.is_blank("text"), F.col("line_no")))
    return j.groupBy("doc_id").agg(F.when(F.first("first").isNull(), 0).otherwise(F.coalesce(above, F.lit(0))).alias("toc_end"))


def join_body(lines: DataFrame, body: str = X.CJK_BODY, glue: str = "") -> DataFrame:
    """doc_id, line_no (of the first line), text: broken lines joined to paragraphs.

    Blank lines, section headers and outline entries end a paragraph and stand alone; page numbers
    go. A paragraph opens at a line with a body character and then takes every line; other lines
    before it stand alone.
    """
    s = X.strip("text")
    d = lines.withColumn("s", s)
    breaks = X.is_blank("s") | X.is_section_header("s") | X.is_outline_toc("s")
    d = d.withColumn("breaks", breaks).where(F.col("breaks") | ~X.is_page_number("s"))
    d = d.withColumn("island", F.sum(F.col("breaks").cast("int")).over(_running()))
    opens = F.min(F.when(~F.col("breaks") & F.col("s").rlike(body), F.col("line_no"))).over(Window.partitionBy("doc_id", "island"))
    inside = ~F.col("breaks") & F.coalesce(F.col("line_no") >= opens, F.lit(False))
    d = d.withColumn("start", F.when(inside, opens).otherwise(F.col("line_no")))
    sorted_ = F.array_sort(F.collect_list(F.struct("line_no", "s")))
    return d.groupBy("doc_id", "start").agg(F.array_join(F.transform(sorted_, lambda x: x["s"]), glue).alias("text")).withColumnRenamed("start", "line_no")


def collapse_blanks(lines: DataFrame) -> DataFrame:
    """Of consecutive blank lines the first stays; blank lines at the end go."""
    blank = X.is_blank("text")
    last = F.max(F.when(~blank, F.col("line_no"))).over(Window.partitionBy("doc_id"))
    d = lines.withColumn("again", blank & F.coalesce(F.lag(blank).over(_doc()), F.lit(False))).withColumn("last", last)
    return d.where(~F.col("again") & (F.col("line_no") <= F.col("last"))).select("doc_id", "line_no", "text")


def dehyphenate(lines: DataFrame, chains: bool = True) -> DataFrame:
    """Lines that end in a hyphen are joined with a next line that starts in lower case.

    With ``chains`` a joined line may go on; without, a line takes one next line at most.
    """
    joins = F.col("text").rlike("-\\z") & F.coalesce(F.lead("text").over(_doc()).rlike("\\A\\p{Ll}"), F.lit(False))
    d = lines.withColumn("joins", joins)
    d = d.withColumn("first", (~F.coalesce(F.lag("joins").over(_doc()), F.lit(False))).cast("int")).withColumn("island", F.sum("first").over(_running()))
    if not chains:
        k = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("line_no"))
        d = d.withColumn("half", F.floor((k - 1) / 2))
    else:
        d = d.withColumn("half", F.lit(0))
    sorted_ = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    n = F.size(sorted_)
    joined = F.array_join(F.transform(sorted_, lambda x, i: F.when(i < n - 1, F.regexp_replace(x["text"], "-\\z", "")).otherwise(x["text"])), "")
    return d.groupBy("doc_id", "island", "half").agg(F.min("line_no").alias("start"), joined.alias("joined")).select("doc_id", F.col("start").alias("line_no"), F.col("joined").alias("text"))


def batches(rows: DataFrame, size: int, context: int = 1, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, batch, role, order: rows in batches of ``size`` (role ``focus``), with ``context`` rows before and after each (role ``context``).

    A row knows its neighbours' batches from its number, so no self-join is needed.
    """
    w = Window.partitionBy(key)
    d = rows.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    own = F.floor(F.col("rn") / size).cast("int")
    reach = F.sequence(F.floor(F.greatest(F.col("rn") - context, F.lit(0)) / size), F.floor(F.least(F.col("rn") + context, F.col("n") - 1) / size))
    d = d.withColumn("own", own).withColumn("batch", F.explode(reach)).withColumn("batch", F.col("batch").cast("int"))
    return d.withColumn("role", F.when(F.col("batch") == F.col("own"), "focus").otherwise("context")).select(key, "batch", "role", order)


def first_mentions(docs: DataFrame, terms: list[str], mark: str = "*") -> DataFrame:
    """``docs`` with the first occurrence of each term as a whole word in ``text`` set between marks, in the given order of terms."""
    c: Column = F.col("text")
    for t in terms:
        quoted = t.replace("\\E", "\\E\\\\E\\Q")
        at = F.regexp_instr(c, F.lit(f"(?U)\\b\\Q{quoted}\\E\\b"))
        before, after = F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(t), F.length(c))
        c = F.when(at > 0, F.concat(before, F.lit(f"{mark}{t}{mark}"), after)).otherwise(c)
    return docs.withColumn("text", c)


def body_from(lines: DataFrame, marker: str) -> DataFrame:
    """Lines from the first that holds ``marker`` on; none without it."""
    first = lines.groupBy("doc_id").agg(F.min(F.when(F.col("text").contains(marker), F.col("line_no"))).alias("first"))
    return lines.join(first, "doc_id").where(F.col("line_no") >= F.col("first")).select("doc_id", "line_no", "text")


def paragraphs_by_style(lines: DataFrame, gap: float = 1.6) -> DataFrame:
    """doc_id, paragraph, style, text from styled lines (doc_id, line_no, text, font, size, y, is_bullet).

    A line starts a paragraph when it is a bullet, its font or size changes, or the step down is over
    ``gap`` times its size. A paragraph has the style of its first line.
    """
    lag = lambda c: F.lag(c).over(_doc())
    starts = lag("line_no").isNull() | F.col("is_bullet") | (F.col("font") != lag("font")) | (F.abs(F.col("size") - lag("size")) > 0.5) | (F.col("y") - lag("y") > gap * F.col("size")) | (F.col("y") < lag("y"))
    d = lines.withColumn("starts", starts.cast("int")).withColumn("paragraph", F.sum("starts").over(_running()))
    sorted_ = F.array_sort(F.collect_list(F.struct("line_no", "text", "font", "size")))
    return d.groupBy("doc_id", "paragraph").agg(sorted_.alias("l")).select("doc_id", "paragraph", F.concat_ws("/", F.col("l")[0]["font"], F.col("l")[0]["size"].cast("string")).alias("style"), F.array_join(F.transform("l", lambda x: X.strip(x["text"])), " ").alias("text"))


def rate_audit(requests: DataFrame, seconds: int = 60, max_requests: int = 200, max_tokens: float = 2_000_000) -> DataFrame:
    """``requests`` (key, ts_ms, tokens) with requests and tokens of the window that ends in each, and whether both limits hold."""
    w = Window.partitionBy("key").orderBy("ts_ms").rangeBetween(-seconds * 1000, 0)
    d = requests.withColumns({"window_requests": F.count("*").over(w), "window_tokens": F.sum("tokens").over(w)})
    return d.withColumn("within", (F.col("window_requests") <= max_requests) & (F.col("window_tokens") <= max_tokens))


def sentence_matches(docs: DataFrame, prefixes: tuple[int, ...] = (60, 30)) -> DataFrame:
    """doc_id, sentence, found: each sentence of ``text`` looked for in ``body``: whole, then its beginnings."""
    d = docs.select("doc_id", X.normalise_search("body").alias("body"), F.explode(X.sentences("text")).alias("sentence"))
    key = X.normalise_search("sentence")
    found = F.when(F.col("body").contains(key), "full")
    for n in prefixes:
        found = found.when((F.length(key) > n) & F.col("body").contains(F.substring(key, 1, n)), f"first {n}")
    return d.select("doc_id", "sentence", found.alias("found"))
