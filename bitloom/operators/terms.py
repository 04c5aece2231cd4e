"""Glossary search, term maps and terminology fidelity.

A term table has row_id, zh, en, loc, source. The order of results is total: exact matches, longer
terms, source authority, row_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from . import containment
from .gate import FAIL, PASS, SKIP, WARN

# Glossary sources by authority; all others come after them.
AUTHORITY = ("DoT定稿", "内部特色词", "佛教术语", "经论名")
DEFAULT_LIMIT = 20


def authority(source: Column | str, order: tuple[str, ...] = AUTHORITY) -> Column:
    c = X.as_column(source)
    ranks = reduce(lambda w, x: w.when(c == x[1], x[0]), enumerate(order[1:], 1), F.when(c == order[0], 0)) if order else F
    return ranks.otherwise(len(order)) if order else F.lit(0)


def parse_query(words: list[str]) -> dict:
    """query, loc, src and limit of a command line: ``loc:`` and ``src:`` words, and a number at the end."""
    out = {"query": [], "loc": None, "src": None, "limit": DEFAULT_LIMIT}
    rest = list(words)
    if len(rest) > 1 and rest[-1].isdigit():
        out["limit"] = int(rest.pop())
    for w in rest:
        name, colon, value = w.partition(":")
        if colon and name in ("loc", "src"):
            out[name] = value
        else:
            out["query"].append(w)
    return out | {"query": " ".join(out["query"])}


def matches(query: str | None, loc: str | None = None, src: str | None = None) -> Column:
    """All words of the query occur in zh or en; loc contains and source equals, where given and not empty."""
    found = [X.contains_like("zh", w) | X.contains_like("en", w) for w in (query or "").split()]
    if loc:
        found.append(X.contains_like("loc", loc))
    if src:
        found.append(F.col("source") == src)
    return reduce(lambda a, b: a & b, found, F.lit(True))


def search(terms: DataFrame, query: str | None = "", loc: str | None = None, src: str | None = None, limit: int | None = DEFAULT_LIMIT, order: tuple[str, ...] = AUTHORITY) -> DataFrame:
    """rank, row_id, zh, en, loc, source of the best ``limit`` rows (None: all; 0: none)."""
    exact = F.when(F.lit(bool((query or "").strip())) & (F.trim("zh") == (query or "").strip()), 0).otherwise(1)
    keys = [exact, F.length(F.trim("zh")).desc(), authority("source", order), F.col("row_id")]
    found = terms.where(matches(query, loc, src)).orderBy(*keys)
    if limit is not None:
        found = found.limit(limit)
    return found.select("row_id", "zh", "en", F.coalesce("loc", F.lit("")).alias("loc"), "source")


def term_map(terms: DataFrame, candidates: DataFrame, limit: int = DEFAULT_LIMIT, order: tuple[str, ...] = AUTHORITY) -> DataFrame:
    """source, sense, preferred, allowed, sources, status for each candidate (source, sense, ord).

    The search for a candidate puts its exact matches first, so taking exact matches out of its best
    ``limit`` results is an equi-join and a rank; no containment join is needed. Of candidates with
    one source the first counts. Of renderings equal but for case the first stays, and none that equals the preferred one.
    """
    c = candidates.withColumn("source", X.strip("source")).where("source <> ''")
    first = Window.partitionBy("source").orderBy("ord")
    c = c.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    t = terms.select(F.trim("zh").alias("zh_"), "row_id", F.trim(F.coalesce("en", F.lit(""))).alias("en"), F.trim(F.coalesce("source", F.lit(""))).alias("label"), authority("source", order).alias("rank"))
    best = Window.partitionBy("zh_").orderBy("rank", "row_id")
    exact = t.withColumn("k", F.row_number().over(best)).where(F.col("k") <= limit)
    rows = exact.groupBy("zh_").agg(F.array_sort(F.collect_list(F.struct("k", "en", "label"))).alias("hits"))
    joined = c.join(rows, c.source == rows.zh_, "left")
    preferred = F.col("hits")[0]["en"]
    others = F.filter(F.transform("hits", lambda h: h["en"]), lambda e: (e != "") & (F.lower(e) != F.lower(preferred)))
    labels = F.array_distinct(F.filter(F.transform("hits", lambda h: h["label"]), lambda s: s != ""))
    known = F.col("hits").isNotNull()
    return joined.select(
        "source", F.coalesce("sense", F.lit("")).alias("sense"), "ord",
        F.when(known, preferred).alias("preferred"),
        F.when(known, distinct_ignoring_case(others)).otherwise(F.array().cast("array<string>")).alias("allowed"),
        F.when(known, labels).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.when(known, "selected").otherwise("needs_human").alias("status"),
    )


def distinct_ignoring_case(values: Column) -> Column:
    """``values`` without those that an earlier one equals but for case."""
    keys = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def audit(terms: DataFrame) -> DataFrame:
    """rows, distinct terms, terms with several renderings, and terms of the first authority."""
    t = terms.select(F.trim("zh").alias("zh"), F.trim("en").alias("en"), "source").where("zh <> ''")
    per = t.groupBy("zh").agg(F.countDistinct("en").alias("n"))
    a = terms.agg(F.count("*").alias("rows"))
    b = per.agg(F.count("*").alias("distinct_zh"), F.count_if(F.col("n") > 1).alias("several_en"))
    c = t.where(F.col("source") == AUTHORITY[0]).agg(F.countDistinct("zh").alias("authoritative_zh"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def per_source(terms: DataFrame) -> DataFrame:
    return terms.groupBy("source").agg(F.count("*").alias("n"))


def unify(*sheets: tuple[DataFrame, dict[str, str | None]]) -> DataFrame:
    """UNION ALL of term sheets, each with a map of zh, en, loc, source to its columns (or ``=constant``); empty pairs go."""
    def branch(df: DataFrame, names: dict[str, str | None]) -> DataFrame:
        column = lambda n: F.lit(None).cast("string") if n is None else F.lit(n[1:]) if n.startswith("=") else F.col(f"`{n}`").cast("string")
        d = df.select(*(column(names.get(k)).alias(k) for k in ("zh", "en", "loc", "source")))
        return d.where((F.trim(F.coalesce("zh", F.lit(""))) != "") & (F.trim(F.coalesce("en", F.lit(""))) != ""))

    return reduce(DataFrame.unionByName, (branch(*s) for s in sheets))


def occurrences(docs: DataFrame, terms: DataFrame, broadcast_chars: int = 8 << 20) -> DataFrame:
    """doc_id, term, n: non-overlapping occurrences of each distinct term in each text.

    Terms of up to ``broadcast_chars`` characters in all are sent to the executors as one automaton,
    which reads each text once. A larger term table is looked up in an index (:func:`.containment.occurrences`).
    """
    t = terms.select("term").where("term <> ''").distinct()
    chars = t.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if chars > broadcast_chars:
        return containment.occurrences(docs, t)
    box = docs.sparkSession.sparkContext.broadcast([r.term for r in t.collect()])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        tree = ahocorasick.Automaton()
        for term in box.value:
            tree.add_word(term, term)
        if box.value:
            tree.make_automaton()
        for f in frames:
            rows = []
            for d, text in zip(f["doc_id"], f["text"], strict=True):
                count: dict[str, int] = {}
                reach: dict[str, int] = {}  # end of the last occurrence counted
                for end, term in tree.iter(text) if text and box.value else ():
                    if end - len(term) + 1 >= reach.get(term, 0):
                        count[term], reach[term] = count.get(term, 0) + 1, end + 1
                rows += [(d, term, n) for term, n in count.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "n"])

    return docs.select("doc_id", "text").mapInPandas(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, term string, n long")


# --- terminology fidelity -------------------------------------------------------------------


def whole_pattern(rendering: Column) -> Column:
    """A regular expression for a rendering as a whole: any white space between its words, and no word going on at an alphanumeric edge."""
    r = X.strip(rendering)
    quoted = F.transform(F.split(X.squeeze(r), " "), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    edge = lambda c, look: F.when(c.rlike("[\\p{L}\\p{N}]"), F.lit(look)).otherwise(F.lit(""))
    return F.concat(F.lit("(?iU)"), edge(F.substring(r, 1, 1), "(?<!\\w)"), F.array_join(quoted, "\\s+"), edge(F.right(r, F.lit(1)), "(?!\\w)"))


def ranked_patterns(renderings: Column) -> Column:
    """Patterns of distinct renderings, the longest first; of equally long ones the earlier first."""
    known = F.array_distinct(F.filter(renderings, lambda r: ~X.is_blank(r)))
    ranked = F.array_sort(F.transform(known, lambda r, i: F.struct((-F.length(r)).alias("size"), i.alias("i"), whole_pattern(r).alias("p"))))
    return F.transform(ranked, lambda x: x["p"])


_TAKEN = "\u0000"


def renderings_in(text: Column, patterns: Column) -> Column:
    """How often ``text`` holds any of the renderings, longer ones first, none overlapping another.

    What a rendering takes is blotted out before the next one is looked for, and the blots are counted.
    """
    blots = lambda t: F.length(t) - F.length(F.replace(t, F.lit(_TAKEN), F.lit("")))
    return blots(F.aggregate(patterns, text, lambda t, p: F.regexp_replace(t, p, F.lit(_TAKEN)))) - blots(text)


def terminology(docs: DataFrame, policy: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, status, checked, failed, unresolved, warned: comma-joined terms.

    ``policy``: source, renderings (array), forbidden (array), needs_human. A forbidden rendering
    fails a term and nothing else of it is looked at; a term awaiting a decision is unresolved; no
    rendering fails; too few warn, or fail in strict runs below 99 %. Documents without a term skip.
    """
    # terms belong to a source text, so rows with one doc_id, or none, stay apart, and equal texts share theirs
    joined = F.coalesce(F.array_join("src", "\n"), F.lit(""))
    keyed = docs.withColumn("key", F.sha2(joined, 256))
    found = occurrences(keyed.select(F.col("key").alias("doc_id"), joined.alias("text")), policy.select(F.col("source").alias("term")))
    n = found.select(F.col("doc_id").alias("key"), "term", "n").dropDuplicates(["key", "term"])
    # patterns are made once for each term, before it meets documents
    ready = policy.select(F.col("source").alias("term"), ranked_patterns(F.col("renderings")).alias("good"), ranked_patterns(F.col("forbidden")).alias("bad"), "needs_human")
    met = n.join(ready, "term").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "n", "good", "bad", "needs_human"))).alias("terms"))
    whole = keyed.select("doc_id", "key", F.lower(F.array_join("tgt", " ")).alias("target")).join(met, "key", "left")
    target = F.coalesce("target", F.lit(""))
    judged = F.transform("terms", lambda t: F.struct(
        t["term"].alias("term"), t["n"].alias("n"), t["needs_human"].alias("open"), renderings_in(target, t["good"]).alias("hits"),
        F.exists(t["bad"], lambda p: F.rlike(target, p)).alias("bad"),
    ))
    few = (lambda t: t["hits"] < 0.99 * t["n"]) if strict else (lambda t: F.lit(False))
    state = lambda t: F.when(t["bad"], "failed").when(t["open"], "unresolved").when((t["hits"] == 0) | few(t), "failed").when(t["hits"] < t["n"], "warned").otherwise("")
    d = whole.select("doc_id", F.coalesce(F.size("terms"), F.lit(0)).alias("checked"), F.transform(judged, lambda t: F.struct(t["term"].alias("term"), state(t).alias("state"))).alias("states"))
    names = lambda k: F.array_join(F.transform(F.filter(F.coalesce("states", F.array().cast("array<struct<term:string,state:string>>")), lambda t: t["state"] == k), lambda t: t["term"]), ",")
    has = lambda k: F.exists("states", lambda t: t["state"] == k)
    status = F.when(F.col("checked") <= 0, SKIP).when(has("failed"), FAIL).when(has("unresolved"), SKIP).when(has("warned"), WARN).otherwise(PASS)
    return d.select("doc_id", status.alias("status"), F.greatest("checked", F.lit(0)).alias("checked"), names("failed").alias("failed"), names("unresolved").alias("unresolved"), names("warned").alias("warned"))
