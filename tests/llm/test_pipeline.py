import corpus_pipeline as C

from bitloom.llm.common import materialize
from bitloom.llm.decontamination import decontaminate
from bitloom.llm.quality_rules import apply_rules, fit_rules

from .. import oracle
from .test_decontamination import brute as brute_hits
from .test_packing import check as check_packing
from .test_secret_scan import brute as brute_secrets
from .test_simhash import brute_components

SF = "/root/testdata/sf0.01"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = dict(C.STAGES)
    assert list(steps) == ["quality_rules", "simhash_dedup", "decontamination", "secret_scan", "packing"]

    one = materialize(steps["quality_rules"](spark, docs, SF), "t")
    rules = fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {d for d, _ in pairs(one)} == {r.doc_id for r in apply_rules(docs, rules).collect() if not r.base_failed and r.rule == 0}

    two = materialize(steps["simhash_dedup"](spark, one, SF), "t")
    first = {d for d, _, c in brute_components(pairs(one)) if c == d}
    assert sorted(pairs(two)) == sorted(r for r in pairs(one) if r[0] in first)

    three = materialize(steps["decontamination"](spark, two, SF), "t")
    items = oracle.connect(SF).execute("SELECT item_id, text FROM benchmark").fetchall()
    clean = {r[0] for r in brute_hits(pairs(two), items) if not r[5]}
    assert {d for d, _ in pairs(three)} == clean and len(clean) < two.count()

    four = materialize(steps["secret_scan"](spark, three, SF), "t")
    before, after = dict(pairs(three)), {r.doc_id: r for r in four.collect()}
    assert set(before) == set(after)
    for d, r in after.items():
        had = brute_secrets(before[d])[1]
        assert bool(had) <= ("[SECRET]" in r.text) and (r.text == before[d] or "[SECRET]" in r.text) and r.n_chars == len(r.text)
        assert brute_secrets(r.text)[1] == []

    assert one.columns == two.columns == three.columns == four.columns == names
    check_packing(steps["packing"](spark, four, SF).collect(), pairs(four))


def test_odd_rows(spark, odd_docs, no_docs):
    """Nulls, repeated rows, empty tables and extra columns go through every stage."""
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in C.STAGES:
            docs = materialize(stage(spark, docs, oracle.SF), name)
        docs.collect()
    kept = C.simhash_dedup(spark, odd_docs, oracle.SF)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))


def test_query_is_the_stages(spark):
    got = C.run(spark, oracle.SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    assert decontaminate(spark.read.parquet(f"{oracle.SF}/documents.parquet").limit(0), spark.read.parquet(f"{oracle.SF}/benchmark.parquet")).count() == 0


def test_repeated_rows_become_one_before_the_shuffle(spark):
    """Copies of one row are added up in the map tasks, and of rows that differ elsewhere the same one stays in any order."""
    rows = [(None, "", "en", "a"), (None, "", "en", "b"), (7, "some words of one text", "de", "x"), (7, "some words of one text", "en", "y")] * 50
    kept = []
    for parts in (1, 3, 7):
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)
        out = C.simhash_dedup(spark, d, "")
        kept.append(sorted(map(tuple, out.collect()), key=repr))
        assert "partial_min_by" in out._jdf.queryExecution().executedPlan().toString()
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2
