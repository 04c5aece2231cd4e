"""Learned quality rules: an ordered decision list over text statistics, native to Spark.

Statistics are DataFrame expressions inside one row; no text leaves the JVM. Repeated 5-word
windows are found exactly: each word is hashed once and five neighbours' hashes make a window's, and only texts
in which a window's hash occurs twice (equal windows have equal hashes) sort their (hash, window, position)
triples and compare neighbours.

The verdict is a decision list learned by sequential covering: each rule is grown as a
conjunction of thresholds by FOIL gain on a grow set, pruned from its end on a prune set, and
kept while its precision is good enough, both on the rows of the prune set that it covers and on all of its
rows; covered rows are removed and the next rule is learned. The list becomes one CASE expression (:func:`DecisionList.to_column`, also ``to_sql``).

Fitting uses at most ``max_labelled`` labelled rows (those with the least hash of the id), whose
statistics are the only rows brought to the driver, one for each id however often it is repeated (that with
the least word count); all rows are scored.

Rows: null and empty texts have no words and fail the base; very long texts are read whole; repeated rows each get
their own verdict; values at a threshold (ties) pass as the rule's <= or >= says; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[ \t-\r]+"
#: Names of the statistics that rules may test. All are shares or means, so that a rule does not turn on length alone.
FEATURES = ("mean_word_chars", "symbol_share", "symbols_per_word", "dup_line_share", "repeat_share", "letter_share", "upper_share", "line_words", "max_run_share", "lone_symbol_share")
_INSIDE = ("__words", "__each", "__hashes", "__sorted", "__repeats", "__lines", "__text")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def add_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and FEATURES added (existing columns of these names are replaced)."""
    docs = docs.drop(*BASE, *FEATURES, *_INSIDE)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumn("__text", text)
    d = d.withColumn("__words", F.array_remove(F.split("__text", SPACE, -1), ""))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("__each", F.transform("__words", lambda w: F.xxhash64(w)))
    five = F.arrays_zip(*(F.slice("__each", k + 1, F.size("__each") - 4).alias(f"h{k}") for k in range(5)))
    d = d.withColumn("__hashes", F.when(F.col("n_words") >= 5, F.transform(five, lambda w: F.xxhash64(w))))
    twice = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    triples = F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), F.slice("__words", i + 1, 5).alias("w"), i.alias("i")))
    d = d.withColumn("__sorted", F.when(twice, F.sort_array(triples)))
    size = F.size("__sorted")

    def repeated(t: Column, k: Column) -> Column:
        before, after = F.get("__sorted", k - 1), F.get("__sorted", k + 1)
        same = (F.coalesce(before["h"] == t["h"], F.lit(False)) & F.coalesce(before["w"] == t["w"], F.lit(False))) | (F.coalesce(after["h"] == t["h"], F.lit(False)) & F.coalesce(after["w"] == t["w"], F.lit(False)))
        return F.when(same, t["i"]).otherwise(F.lit(-1))

    starts = F.filter(F.transform("__sorted", repeated), lambda i: i >= 0)
    d = d.withColumn("__repeats", F.when(size > 0, F.sort_array(starts)))
    gaps = F.transform("__repeats", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("__repeats", k + 1), p + 5) - p))
    repeat_words = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    # The condition always holds. Being non-deterministic it keeps filters on the results above this
    # projection; pushed below, they would repeat the array columns inside the lambdas of others.
    d = d.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, F.coalesce(repeat_words, F.lit(0)).cast("long")))
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")))
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long"))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    letters = F.length(F.regexp_replace("__text", r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace("__text", r"[^\p{Lu}]+", ""))
    d = d.withColumns({
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "letter_share": letters / chars,
        "upper_share": upper / F.greatest(letters, F.lit(1)),
        "line_words": F.col("n_words") / F.greatest(F.size("__lines"), F.lit(1)),
        "max_run_share": F.size(F.filter("__words", lambda w, k: w == F.get("__words", k - 1))) / words,
        "lone_symbol_share": F.size(F.filter("__words", lambda w: F.length(w) == 1)) / words,
    })
    return d.drop(*_INSIDE)


@dataclass(frozen=True)
class Threshold:
    feature: str
    at_least: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.value if self.at_least else row[self.feature] <= self.value

    def to_sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value!r}D"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects, and what none covers is kept."""

    rules: list[tuple[Threshold, ...]] = field(default_factory=list)

    def rejects(self, row: dict) -> bool:
        return any(all(t.holds(row) for t in r) for r in self.rules)

    def to_sql(self) -> str:
        """A CASE expression: the number of the rule that rejects the row, or 0."""
        cases = " ".join(f"WHEN {' AND '.join(t.to_sql() for t in r)} THEN {i}" for i, r in enumerate(self.rules, 1))
        return f"CASE {cases} ELSE 0 END" if cases else "0"

    def to_column(self) -> Column:
        return F.expr(self.to_sql())


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _best(rows: list[tuple[dict, int]]) -> tuple[float, Threshold] | None:
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    best = None
    for f in FEATURES:
        order = sorted((r[f], y) for r, y in rows)
        p = n = 0
        for k, (v, y) in enumerate(order):
            p, n = p + y, n + 1 - y
            if k + 1 < len(order) and order[k + 1][0] == v:
                continue
            cut = float(f"{(v + order[k + 1][0]) / 2:.6g}") if k + 1 < len(order) else v
            if k + 1 < len(order) and not v <= cut < order[k + 1][0]:
                cut = v
            for at_least, a, b, c in ((False, p, n, cut), (True, p0 - p, n0 - n, cut)):
                if a and a + b < len(rows) and (g := _gain(p0, n0, a, b)) > 1e-9 and (best is None or g > best[0]):
                    # ">=" takes values over the cut, so it must be above v itself
                    c = c if not at_least or c > v else order[k + 1][0]
                    best = (g, Threshold(f, at_least, float(c)))
    return best


def learn(rows: list[tuple[dict, int]], *, min_precision: float = 0.9, max_rules: int = 16, max_tests: int = 4, min_cover: int = 3) -> DecisionList:
    """Rules for class 1 (to reject) by sequential covering. Every third row is in the prune set."""
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if i % 3 == 0]
    out = DecisionList()
    while len(out.rules) < max_rules and sum(y for _, y in grow) >= min_cover:
        rule: list[Threshold] = []
        left = grow
        while len(rule) < max_tests and any(1 - y for _, y in left):
            found = _best(left)
            if found is None:
                break
            rule.append(found[1])
            left = [r for r in left if found[1].holds(r[0])]
        if not rule:
            break

        def worth(tests: list[Threshold]) -> tuple[float, int]:
            got = [y for r, y in prune if all(t.holds(r) for t in tests)]
            p = sum(got)
            return ((2 * p - len(got)) / len(got) if got else -1.0, -len(tests))

        if any(all(t.holds(r) for t in rule[:1]) for r, _ in prune):  # else nothing speaks for a shorter rule
            rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        got = [y for r, y in rows if all(t.holds(r) for t in rule)]
        unseen = [y for r, y in prune if all(t.holds(r) for t in rule)]
        if sum(got) < min_cover or sum(got) < min_precision * len(got) or sum(unseen) < min_precision * len(unseen):
            break
        out.rules.append(tuple(rule))
        grow = [r for r in grow if not all(t.holds(r[0]) for t in rule)]
        prune = [r for r in prune if not all(t.holds(r[0]) for t in rule)]
        rows = [r for r in rows if not all(t.holds(r[0]) for t in rule)]
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 6000) -> DecisionList:
    """A decision list that rejects label 0. Null labels and ids are left out; no labelled rows give an empty list."""
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # the sample has max_labelled rows of two numbers at most, so it may be broadcast
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # one row for each id, whatever the number of its rows
    least = add_statistics(slim).groupBy("id", "label").agg(F.min(F.struct("n_words", *FEATURES)).alias("s"))
    seen = {r.id: ({f: float(r.s[f]) for f in FEATURES}, int(r.label == 0)) for r in least.collect()}
    ordered = sorted(seen, key=lambda i: (i * 0x9E3779B97F4A7C15 % 2**64, i))
    return learn([seen[i] for i in ordered])


def apply_rules(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> DataFrame:
    """``docs`` with statistics, base_failed, rule (number of the rejecting rule or 0) and kept added.

    Null and empty texts have no words, so they fail the base. Repeated rows each get their own
    verdict. Columns besides the added ones pass through.
    """
    d = add_statistics(docs.drop("base_failed", "rule", "kept"), text_col)
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("rule", rules.to_column().cast("int"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).select("doc_id", *BASE, "base_failed", "rule", "kept")
