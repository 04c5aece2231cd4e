"""Article assembly: write-back, sections, verses, bold fragments, fidelity, checkpoints, focus output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X


def write_back(runs: DataFrame, translated: DataFrame, keys: tuple[str, ...] = ("slide", "shape", "run")) -> DataFrame:
    """``runs`` with text replaced by the translation of the same key; of several the last (by ``ord``) counts, and an empty one changes nothing."""
    last = translated.groupBy(*keys).agg(F.max_by("text", "ord").alias("new"))
    new = F.when(~X.is_blank("new"), F.col("new"))
    return runs.join(last, list(keys), "left").withColumn("text", F.coalesce(new, "text")).drop("new")


def missing_candidates(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates (doc_id, source) that don't occur in their document's text (an anti-join by containment within the document)."""
    t = documents.select("doc_id", "text")
    return candidates.join(t, "doc_id", "left").where(~F.coalesce(F.contains("text", F.col("source")), F.lit(False))).select("doc_id", "source")


# How a heading and a subheading are numbered.
HEADING_NUMBER, SUBHEADING_NUMBER = "\\A[一二三四五六七八九十]、", "\\A\\d+\\\\?\\.\\s"


def classify_pairs(pairs: DataFrame, contents: int = 8) -> DataFrame:
    """``pairs`` (doc_id, ord from 0, cn, en) with kind: title, subtitle, then ``contents`` entries, then heading, subheading or para by numbering."""
    kind = (
        F.when(F.col("ord") == 0, "title").when(F.col("ord") == 1, "subtitle").when(F.col("ord") < 2 + contents, "toc")
        .when(F.col("cn").rlike(HEADING_NUMBER), "heading").when(F.col("cn").rlike(SUBHEADING_NUMBER), "subheading").otherwise("para")
    )
    return pairs.withColumn("kind", kind)


def sections(*parts: DataFrame) -> DataFrame:
    """doc_id, section, row, sub, text in total order from parts (doc_id, row, sub, text): an article's title, contents and body, one after the other."""
    numbered = [p.select("doc_id", F.lit(i).alias("section"), "row", "sub", "text") for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def article(classified: DataFrame, contents_cn: str, contents_en: str) -> DataFrame:
    """The bilingual article of classified pairs: title block, Chinese contents, English contents, body with a blank line after each pair."""
    pair = F.posexplode(F.array("cn", "en", F.lit("")))
    both = lambda d: d.select("doc_id", F.col("ord").alias("row"), pair.alias("sub", "text"))
    head = lambda text: classified.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("row"), F.lit(0).alias("sub"), F.lit(text).alias("text"))
    toc = classified.where("kind = 'toc'")
    side = lambda c: toc.select("doc_id", F.col("ord").alias("row"), F.lit(0).alias("sub"), F.col(c).alias("text"))
    top, body = classified.where("kind in ('title', 'subtitle')"), classified.where("kind not in ('title', 'subtitle', 'toc')")
    return sections(both(top), head(contents_cn).unionByName(side("cn")), head(contents_en).unionByName(side("en")), both(body))


def fidelity(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, same: whether two plain-text forms (doc_id, text) of a document agree by digest, white space squeezed; a missing one doesn't."""
    d = lambda t, n: t.select("doc_id", X.sha256_hex(X.squeeze("text")).alias(n))
    return d(left, "a").join(d(right, "b"), "doc_id", "full_outer").select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def unchanged(before: DataFrame, now: DataFrame, name: str = "path") -> DataFrame:
    """name, state of inputs by sha256: same, changed, gone or new; to be checked before a commit."""
    j = before.select(name, F.col("sha256").alias("a")).join(now.select(name, F.col("sha256").alias("b")), name, "full_outer")
    return j.select(name, F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("state"))


def remaining(batches: DataFrame, checkpoint: DataFrame, settings: str) -> DataFrame:
    """Batches (project, batch, source_sha256) still to be done: those that the checkpoint lacks for the current inputs and settings."""
    done = checkpoint.where(F.col("settings") == settings).select("project", "batch", "source_sha256").distinct()
    return batches.join(done, ["project", "batch", "source_sha256"], "left_anti")


def focus_text(focus: DataFrame, form: str = "ids") -> DataFrame:
    """doc_id, text of selected paragraphs (doc_id, line_no, paragraph_id, reasons): ``ids`` one per line, ``args`` as command arguments, or ``json``."""
    item = F.struct("line_no", "paragraph_id", "reasons")
    sorted_ = F.array_sort(F.collect_list(item))
    ids = lambda f, glue: F.array_join(F.transform(sorted_, f), glue)
    text = {
        "ids": ids(lambda x: x["paragraph_id"], "\n"),
        "args": ids(lambda x: F.concat(F.lit("--paragraph "), x["paragraph_id"]), " "),
        "json": F.to_json(F.transform(sorted_, lambda x: F.struct(x["paragraph_id"].alias("paragraph_id"), x["reasons"].alias("reasons")))),
    }[form]
    return focus.groupBy("doc_id").agg(text.alias("text"))


def split_numbered(text: Column | str, least: int = 3) -> Column:
    """Parts of a paragraph that holds at least ``least`` items like ``1)``; else the whole."""
    t = X.as_column(text)
    parts = F.filter(F.transform(F.split(t, "(?=(?<!\\d)\\d+\\))"), X.strip), lambda x: x != "")
    return F.when(F.regexp_count(t, F.lit("\\d+\\)")) >= least, parts).otherwise(F.array(t))


def split_verses(text: Column | str, markers: list[str], least: int = 3) -> Column:
    """Array of (kind, text): steps (一、...), then verse lines cut at markers, where these occur ``least`` times; else one body part."""
    t = X.as_column(text)
    whole = F.array(F.struct(F.lit("body").alias("kind"), t.alias("text")))
    if not markers:
        return whole
    # cutting before every marker and every step gives the same parts whichever comes first
    cut = "(?=" + "|".join([*(f"(?:{m})" for m in markers), "[一二三四五六七八九十]、"]) + ")"
    parts = F.filter(F.transform(F.split(t, cut), X.strip), lambda x: x != "")
    kinds = F.transform(parts, lambda x: F.struct(F.when(x.rlike("^[一二三四五六七八九十]、"), "numbered").otherwise("verse_line").alias("kind"), x.alias("text")))
    n = reduce(lambda a, m: a + F.regexp_count(t, F.lit(m)), markers, F.lit(0))
    return F.when(n >= least, kinds).otherwise(whole)


def join_bold(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, text) with a bold line joined to the next non-blank one that goes on without opening bold.

    Where the second closes bold the joined line does; a second line that closes nothing is joined as
    it is. Of a chain each line takes part in one join.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    s = X.strip("text")
    solid = lines.withColumn("s", s).where(~X.is_blank("s"))
    opens = F.col("s").startswith("**") & F.col("s").endswith("**") & (F.length("s") > 4)
    nxt = F.lead("s").over(w)
    joins = opens & nxt.isNotNull() & ~nxt.startswith("**")
    d = solid.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("next", nxt)
    d = d.withColumn("taken", F.coalesce(F.lag("joins").over(w), F.lit(False)))
    text = F.when(F.col("joins"), F.concat(F.regexp_replace("s", "\\s*\\*\\*\\z", ""), F.col("next"))).otherwise(F.col("s"))
    return d.where(~F.col("taken")).select("doc_id", "line_no", text.alias("text"))


def keep_spans(spans: DataFrame, skip_fonts: list[str], skip_size: float, bullet_fonts: list[str]) -> DataFrame:
    """Spans (font, size, ...) without small ones in skipped fonts, with is_bullet by font."""
    bullet = reduce(lambda a, f: a | F.contains("font", F.lit(f)), bullet_fonts, F.lit(False))
    return spans.where(~(F.col("font").isin(*skip_fonts) & (F.col("size") <= skip_size))).withColumn("is_bullet", bullet)


def colour(value: Column | str) -> Column:
    """(r, g, b) of a packed colour; null for 0, which is the default."""
    v = X.as_column(value)
    part = lambda n: F.shiftright(v, n).bitwiseAND(255).cast("int")
    return F.when(v != 0, F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b")))


def strip_page_numbers(text: Column | str) -> Column:
    """Without a stray one- to three-digit number at the end of a line of Chinese text."""
    return F.regexp_replace(X.as_column(text), "(?<=[\\x{3400}-\\x{9FFF}。！？”])\\s*\\d{1,3}\\s*\\z", "")
