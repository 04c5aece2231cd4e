import zlib

import numpy as np
import pytest

from bitloom.llm import toxicity as X


def test_kernel_equals_its_definition():
    """Folded weights give the kernel expansion, and the kernel is that of all triples of gaps."""
    letters = np.array(sorted(map(ord, "abcdefg^$")), np.uint32)
    units, marks = ["abcde", "bxcxdxe", "gfedcba", "ab"], ["abcd", "cdefg"]

    def features(u):
        s, out = f"^{u}$", {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    for m in range(k + 1, min(len(s), i + X.MAX_SPAN)):
                        t = s[i] + s[j] + s[k] + s[m]
                        if all(ord(c) in letters for c in t):
                            out.setdefault(t, []).append(X.DECAY ** (m - i + 1))
        norm = np.sqrt(sum(w * w for v in out.values() for w in v))
        return {t: sum(v) / norm for t, v in out.items()}

    lm = X.Landmarks(marks, letters)
    got = lm.kernel(units)
    want = [[sum(v * features(m).get(t, 0) for t, v in features(u).items()) for m in marks] for u in units]
    assert np.allclose(got, want)
    alpha = np.array([0.7, -1.3])
    model = X.Model(letters, lm.index, lm.fold(alpha), 0.0, 1.0, 0.0)
    assert np.allclose(X.subsequence_sums(X.encode_units(units, letters), model.table()), got @ alpha, atol=1e-6)


@pytest.fixture(scope="module")
def fitted(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return d, labels, X.fit_toxicity(d, labels)


def test_held_out_texts(spark, fitted):
    d, labels, model = fitted
    rows = X.score_toxicity(d.join(labels, "doc_id"), model).select("doc_id", "score", "predicted", "toxic", X.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    y, s = np.array([r.toxic for r in rows if r.h]), np.array([r.score for r in rows if r.h])
    order = np.empty(len(s))
    order[np.argsort(s, kind="stable")] = np.arange(len(s))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    auc = (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)
    assert auc > 0.93 and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_gaps_and_inserted_characters(fitted):
    scorer = X._Scorer(fitted[2])
    import pyarrow as pa

    toxic = scorer(pa.array(["you idiot", "you I.D.I.O.T", "an id-iot here", "i d i o t", "idiiot"]))
    assert (fitted[2].probability(toxic) > 0.3).all()


def test_labels_of_held_out_rows_do_not_count(spark):
    d = spark.createDataFrame([(i, f"word{i % 7} plain text" + (" vileword" if i % 5 == 0 else "")) for i in range(400)], "doc_id long, text string")
    truth = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    lies = truth.withColumn("toxic", X.F.when(X.held_out(), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    a, b = X.fit_toxicity(d, truth), X.fit_toxicity(d, lies)
    assert a.bias == b.bias and (a.weights == b.weights).all()
    got = X.score_toxicity(d, a).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got)


def test_odd_rows(spark, odd_docs, no_docs, fitted):
    got = X.score_toxicity(odd_docs, fitted[2]).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert X.score_toxicity(no_docs, fitted[2]).count() == 0
    none = X.fit_toxicity(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in X.score_toxicity(odd_docs, none).collect()}) == 1


def test_long_labelled_texts_displace_no_others(spark):
    truth = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    first = [truth.where(f"toxic = {k}").where(~X.held_out()).orderBy(X.F.xxhash64("doc_id")).first().doc_id for k in (0, 1)]
    text = lambda i: f"word{i % 7} plain text" + (" vileword" if i % 5 == 0 else "")
    d = spark.createDataFrame([(i, text(i) + (" filler" * 20_000 if i in first else "")) for i in range(400)], "doc_id long, text string")
    model = X.fit_toxicity(d, truth, class_bytes=100_000)
    got = X.score_toxicity(d, model).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got)
    only = X.fit_toxicity(d, truth.where(X.F.col("doc_id").isin(first)), class_bytes=1000)
    assert only.slope > 0  # one long text of each class is still both classes


def test_neighbouring_words(fitted):
    """An insult cut in two, and abuse made of words that are clean alone."""
    import pyarrow as pa

    model = fitted[2]
    scorer = X._Scorer(model)
    p = model.probability(scorer(pa.array(["you id iot", "such an idi ot here", "id", "iot", "some id", "the iot device"])))
    assert (p[:2] > 0.3).all() and (p[2:] < 0.3).all()
    assert np.allclose(scorer(pa.array(["you id", "iot"])), scorer(pa.array(["you id", "iot", None, ""]))[:2])

    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("lam", "ter", "son", "gri") for b in ("pel", "dun", "fay", "kos", "wim")]
    texts = []
    for i in range(900):
        w = rng.choice(words, 14).tolist()
        w = [x for k, x in enumerate(w) if not (k and w[k - 1] == "lampel" and x == "griwim")]
        texts.append((" ".join([*w[:5], "lampel", "griwim", *w[5:]] if i % 3 == 0 else ["griwim", *w, "lampel"]), int(i % 3 == 0)))
    clean_words = X.fit(texts[:600])
    assert clean_words.phrases >= {("lampel", "griwim")}
    got = clean_words.probability(X._Scorer(clean_words)(pa.array([t for t, _ in texts[600:]]))) >= 0.3
    assert np.mean(got == np.array([k for _, k in texts[600:]], bool)) > 0.95


def test_repeated_ids_are_one_text(spark):
    """However often a labelled id is repeated, its shortest text stands for it."""
    truth = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    text = lambda i: f"word{i % 7} plain text" + (" vileword" if i % 5 == 0 else "")
    once = spark.createDataFrame([(i, text(i)) for i in range(200)], "doc_id long, text string")
    many = once.union(spark.createDataFrame([(i % 200, text(i % 200) + " and more text that is longer") for i in range(4000)], "doc_id long, text string"))
    a, b = X.fit_toxicity(once, truth), X.fit_toxicity(many, truth)
    assert (a.weights == b.weights).all() and a.bias == b.bias
