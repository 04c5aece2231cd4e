import re

from hypothesis import given, settings, strategies as st

from bitloom.llm.quality_rules import BASE, FEATURES, DecisionList, Threshold, add_statistics, apply_rules, fit_rules, learn

from .. import oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, repeated = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated.update(j for i in at for j in range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated)


def test_statistics_of_whole_table(spark):
    d = spark.read.parquet(f"{oracle.SF}/documents.parquet")
    got = {r.doc_id: tuple(r[b] for b in BASE) for r in add_statistics(d).select("doc_id", *BASE).collect()}
    assert got == {r.doc_id: brute(r.text) for r in d.collect()}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ä#", "|", "c\n", "\n", " ", "x\x0b", " "]), max_size=60).map(" ".join), min_size=1, max_size=8))
def test_statistics_of_random_texts(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[b] for b in BASE) for r in add_statistics(d).select("doc_id", *BASE).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_reject_junk_and_keep_clean(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = fit_rules(d, labels)
    assert rules.rules
    j = apply_rules(d, rules).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in j}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_filter_on_the_verdict_stays_above_the_windows(spark):
    """Pushed below, the filter would repeat array columns inside lambdas and never end."""
    d = spark.createDataFrame([(1, "a b c d e f " * 2000)], "doc_id long, text string")
    assert apply_rules(d, DecisionList([(Threshold("symbol_share", True, 0.5),)])).where("kept or not kept").count() == 1


def test_list_as_sql_and_as_rows(spark):
    rules = DecisionList([(Threshold("symbol_share", True, 0.25), Threshold("upper_share", False, 0.5)), (Threshold("max_run_share", True, 0.3),)])
    d = spark.createDataFrame([(1, "## ## aa bb cc"), (2, "x x x x y z"), (3, "plain words here")], "doc_id long, text string")
    got = apply_rules(d, rules).collect()
    assert {r.doc_id: r.rule for r in got} == {1: 1, 2: 2, 3: 0}
    assert all(rules.rejects(r.asDict()) == (r.rule > 0) for r in got)
    assert DecisionList().to_sql() == "0"


def test_learning_is_a_covering():
    """Two separate causes of rejection give two rules, each a threshold near its cause."""
    rows = [(dict.fromkeys(FEATURES, 0.0) | {"symbol_share": i / 900, "repeat_share": (i * 37 % 900) / 900}, int(i >= 720 or i * 37 % 900 >= 720)) for i in range(900)]
    found = learn(rows)
    assert sum(found.rejects(r) == bool(y) for r, y in rows) >= 880 and len(found.rules) >= 2
    assert learn([]).rules == [] and learn([(rows[0][0], 0)] * 5).rules == []


def test_odd_rows(spark, odd_docs, no_docs):
    got = apply_rules(odd_docs, DecisionList()).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert tuple(r[b] for b in BASE) == brute(r.text) and r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert apply_rules(no_docs, DecisionList()).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_rules(odd_docs, empty).rules == [] and fit_rules(odd_docs, spark.createDataFrame([(None, 0), (6, None)], "doc_id long, quality int")).rules == []


def test_repeated_ids_count_once(spark):
    """A labelled id with many rows brings one row of statistics to the driver."""
    junk, good = "## || ## || ## " * 5, "plain words of a good text that goes on for a while here"
    docs = spark.createDataFrame([(i % 40, good if i % 2 else junk) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rules = fit_rules(docs, labels)
    assert rules.rules == fit_rules(docs.dropDuplicates(), labels).rules and len(rules.rules) == 1


def test_rules_are_held_to_the_prune_set():
    """A rule that is right on the grow set by accident only isn't kept."""
    rows = [(dict.fromkeys(FEATURES, 0.0) | {"symbol_share": float(i % 3 == 0 or i % 2)}, int(i % 3 != 0 and i % 2)) for i in range(300)]
    assert learn(rows).rules == []
