"""Bilingual files: interleaving, splitting, freshness, freezing, and pairing in mixed documents.

Documents are rows of line arrays, so all of these are narrow and run inside the row; what depends on the order (a
match consumes what later ones may use) is an ordered ``aggregate`` over a document's lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.text import is_blank


def equal_lines(docs: DataFrame) -> DataFrame:
    """Documents whose sides have equally many lines, blank in the same places."""
    return docs.where((F.size("src") == F.size("tgt")) & F.forall(F.zip_with("src", "tgt", lambda s, t: is_blank(s) == is_blank(t)), lambda b: b))


def _triples() -> Column:
    return F.zip_with("src", "tgt", lambda s, t: F.when(is_blank(s), F.array(F.lit(""))).otherwise(F.array(s, t, F.lit(""))))


def bilingual_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lines``: source, target and an empty line for each pair, an empty line for each blank."""
    return docs.withColumn("lines", F.flatten(_triples()))


def interleave(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, ord (1 source, 2 target, 3 separator), text."""
    one = docs.select("doc_id", F.posexplode(_triples()).alias("i", "t"))
    return one.select("doc_id", (F.col("i") + 1).alias("line_no"), F.posexplode("t").alias("k", "text")).select("doc_id", "line_no", (F.col("k") + 1).alias("ord"), "text")


def split_bilingual(docs: DataFrame) -> DataFrame:
    """doc_id, src, tgt from ``lines``: the inverse of :func:`bilingual_lines`.

    Non-blank runs must have two lines each; the first blank after a pair separates, further
    blanks are lines of both sides. A run of another length is an error.
    """
    # a line's role follows from its neighbours, so this is one linear pass without a growing state
    def role(x: Column, i: Column) -> Column:
        nb = lambda k: ~F.coalesce(is_blank(F.get("lines", i + k)), F.lit(True))  # noqa: E731  a non-blank neighbour
        before, before2, after, after2 = F.when(i > 0, nb(-1)).otherwise(False), F.when(i > 1, nb(-2)).otherwise(False), nb(1), nb(2)
        bad = F.raise_error(F.concat(F.lit("not a pair of lines: "), x)).cast("struct<s:string,t:string>")
        pair = lambda s, t: F.struct(s.alias("s"), t.alias("t"))
        nothing = F.lit(None).cast("struct<s:string,t:string>")
        empty = pair(F.lit(""), F.lit(""))
        return (
            F.when(is_blank(x), F.when(before, nothing).otherwise(empty))
            .when(~before, F.when(after & ~after2, pair(x, F.get("lines", i + 1))).otherwise(bad))
            .otherwise(F.when(before2, bad).otherwise(nothing))
        )

    out = docs.select("doc_id", F.filter(F.transform("lines", role), lambda p: p.isNotNull()).alias("out"))
    return out.select("doc_id", F.transform("out", lambda p: p["s"]).alias("src"), F.transform("out", lambda p: p["t"]).alias("tgt"))


def freshness(docs: DataFrame) -> DataFrame:
    """status and differences of ``lines`` against what the sides give now; null ``lines`` are SKIP."""
    now = F.flatten(_triples())
    n = F.size(F.filter(F.zip_with("lines", now, lambda a, b: ~a.eqNullSafe(b)), lambda d: d))
    d = docs.withColumn("differences", F.when(F.col("lines").isNull(), F.lit(0)).otherwise(n))
    return d.withColumn("status", F.when(F.col("lines").isNull(), "SKIP").when(F.col("differences") == 0, "PASS").otherwise("FAIL"))


def freeze_target(docs: DataFrame) -> DataFrame:
    """accepted and reason: a target is frozen only with line and blank parity."""
    parity = F.forall(F.zip_with("src", "tgt", lambda s, t: is_blank(s) == is_blank(t)), lambda b: b)
    reason = F.when(F.size("src") != F.size("tgt"), "line count").when(~parity, "blank lines").otherwise("")
    return docs.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- mixed documents: pairings inside the row ------------------------------------------------


def _trimmed(lines: Column) -> Column:
    return F.transform(lines, X.strip)


def _is_cn(line: Column) -> Column:
    return line.rlike(X.CJK_BASIC)


def _pairs(docs: DataFrame, pairs: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode(pairs).alias("ord", "p")).select("doc_id", "ord", "p.cn", "p.en")


def _pair(cn: Column, en: Column) -> Column:
    return F.struct(cn.alias("cn"), en.alias("en"))


def _neighbour(lines: Column, i: Column) -> Column:
    """The English line right below the Chinese line i, or below one blank line, or null."""
    at = lambda k: F.get(lines, i + k)
    english = lambda x: (x != "") & ~_is_cn(x)
    return F.when(english(at(1)), at(1)).when((at(1) == "") & english(at(2)), at(2))


def neighbour_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, ord, cn, en: a Chinese line and the English line right below it or below one blank line.

    An English line has one Chinese line that can claim it, so each pair is seen from its Chinese line alone.
    """
    def found(lines: Column) -> Column:
        each = F.transform(lines, lambda x, i: F.when(_is_cn(x), _pair(x, _neighbour(lines, i))))
        return F.filter(each, lambda p: p["en"].isNotNull())

    return _pairs(docs, _let(_trimmed(F.col("lines")), found))


# What a paragraph broken by a page does not end in, and what a heading starts with.
_ENDS = "[。！？：）”’，．.!?]$"
_NUMBERED = "^[\\dIVX]+[.\\s]"


def _unbroken(lines: Column, least: int) -> Column:
    """Structs (cn, text) of non-blank lines, joined where a page broke a paragraph: the same language, over ``least`` characters so far, no heading and no end mark."""
    kind = "array<struct<cn: boolean, text: string>>"
    tagged = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(_is_cn(x).alias("cn"), x.alias("text")))

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        heading = last["text"].rlike(_NUMBERED) & (F.length(last["text"]) < 60)
        broken = (last["cn"] == x["cn"]) & ~heading & (F.length(last["text"]) > least) & ~last["text"].rlike(_ENDS)
        joined = F.struct(x["cn"].alias("cn"), F.concat(last["text"], x["text"]).alias("text"))
        return F.when(F.coalesce(broken, F.lit(False)), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), joined)).otherwise(F.array_append(done, x)).cast(kind)

    return F.aggregate(tagged, F.expr(f"cast(array() as {kind})"), step)


def block_pairs(docs: DataFrame, least: int = 30) -> DataFrame:
    """doc_id, ord, cn, en: the n-th Chinese paragraph of a block with the n-th English one of the block below, up to the shorter block.

    Paragraphs broken by a page are joined before (without a space), which depends on the text joined so far: an ordered fold.
    """
    def found(m: Column) -> Column:
        starts = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1)["cn"] != x["cn"]), i)), lambda i: i.isNotNull())

        def blocks(s: Column) -> Column:
            def pairs(a: Column, k: Column) -> Column:
                b, c = F.get(s, k + 1), F.coalesce(F.get(s, k + 2), F.size(m))
                return F.transform(F.sequence(F.lit(0), F.least(b - a, c - b) - 1), lambda j: _pair(F.get(m, a + j)["text"], F.get(m, b + j)["text"]))

            empty = F.expr("cast(array() as array<struct<cn: string, en: string>>)")
            return F.flatten(F.transform(s, lambda a, k: F.when(F.get(m, a)["cn"] & F.get(s, k + 1).isNotNull(), pairs(a, k)).otherwise(empty)))

        return _let(starts, blocks)

    return _pairs(docs, _let(_unbroken(_trimmed(F.col("lines")), least), found))


def _first_free(entries: Column) -> Column:
    """Pairs of ``entries`` (cn, en): an English entry alone (cn null) goes to the first Chinese one before it without English, or stays alone (cn empty).

    The k-th English entry alone that finds one takes the k-th Chinese one, so two running counts decide: of Chinese entries
    waiting so far, and of English ones that found one.
    """
    alone = lambda x: x["cn"].isNull()
    waits = lambda x: x["cn"].isNotNull() & x["en"].isNull()
    start = F.expr("cast(named_struct('waiting', 0, 'met', 0, 'places', array()) as struct<waiting: int, met: int, places: array<int>>)")

    def step(s: Column, x: Column) -> Column:
        meets = alone(x) & (s["met"] < s["waiting"])
        # an entry's place among those that wait, or the one it meets; 0 for all others
        place = F.when(waits(x), s["waiting"] + 1).when(meets, -(s["met"] + 1)).otherwise(0)
        return F.struct((s["waiting"] + waits(x).cast("int")).alias("waiting"), (s["met"] + meets.cast("int")).alias("met"), F.array_append(s["places"], place).alias("places"))

    def joined(places: Column) -> Column:
        numbered = F.zip_with(entries, places, lambda x, p: F.struct(x["cn"].alias("cn"), x["en"].alias("en"), p.alias("place")))

        def all_(e: Column) -> Column:
            english = F.transform(F.filter(e, lambda x: x["place"] < 0), lambda x: x["en"])  # in the order of the places they meet
            kept = F.filter(e, lambda x: x["place"] >= 0)
            return F.transform(kept, lambda x: _pair(F.coalesce(x["cn"], F.lit("")), F.coalesce(x["en"], F.when(x["place"] > 0, F.get(english, x["place"] - 1)), F.lit(""))))

        return _let(numbered, all_)

    return _let(F.aggregate(entries, start, step, lambda s: s["places"]), joined)


def forward_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, ord, cn, en: each English line goes to the first Chinese line before it that has none; lines left over stay, with an empty side."""
    line = lambda x: F.struct(F.when(_is_cn(x), x).alias("cn"), F.when(~_is_cn(x), x).alias("en"))
    entries = F.transform(F.filter(_trimmed(F.col("lines")), lambda x: x != ""), line)
    return _pairs(docs, _let(entries, _first_free))


def mixed_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, ord, cn, en of a document with lines of both languages.

    A line of both is split; a Chinese line takes the English one right below it, or below a blank line, unless it looks like a
    contents entry (a link, or a page after a tab); English lines left over go to the first Chinese line without any before
    them. Lines left over stay, with an empty side. Numbers, heading marks and stars around titles are taken off.
    """
    def entries(lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            parts = X.split_mixed(x)
            contents = x.rlike("\\[.*\\]\\(.*\\)") | F.coalesce(parts["cn"].rlike("\\t\\d+"), F.lit(False))
            own = F.when(parts["en"].isNotNull(), parts["en"]).when(~contents, _neighbour(lines, i))
            cn = lambda k: F.get(lines, i - k).rlike(X.CJK_BASIC)

            def claims(k: int) -> Column:
                y = F.get(lines, i - k)
                p = X.split_mixed(y)
                open_ = p["en"].isNull() & ~y.rlike("\\[.*\\]\\(.*\\)") & ~F.coalesce(p["cn"].rlike("\\t\\d+"), F.lit(False))
                return (i >= k) & F.coalesce(cn(k) & _is_cn(X.without_anchors(y)) & open_, F.lit(False))

            claimed = claims(1) | ((i >= 1) & F.coalesce(F.get(lines, F.greatest(i - 1, F.lit(0))) == "", F.lit(False)) & claims(2))
            chinese = _is_cn(X.without_anchors(x))
            return F.when(x == "", None).when(chinese, F.struct(X.clean_cn(parts["cn"]).alias("cn"), X.clean_en(own).alias("en"))).when(~claimed, F.struct(F.lit(None).cast("string").alias("cn"), X.clean_en(x).alias("en")))

        return F.filter(F.transform(lines, one), lambda e: e.isNotNull())

    return _pairs(docs, _let(_let(_trimmed(F.col("lines")), entries), _first_free))


#: Lengths of the beginnings that places are looked up by: a part has the longest that it reaches.
_KEYS = (25, 8, 1)
_BUCKETS = 256
#: A row of more parts than this has its places hashed once; up to it, each part is simply looked for, which is cheaper.
_MANY = 1000


def _hits(body: Column, keys: Column, size: int) -> Column:
    """Places (from 0) of ``body`` where ``size`` characters have one of the hashes in ``keys``, as structs (h, i)."""
    # a look-ahead takes the piece at each place in one pass; a place is tested against the keys of one bucket only
    pieces = F.regexp_extract_all(body, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    hashed = F.transform(pieces, lambda p, i: F.struct(F.xxhash64(p).alias("h"), i.alias("i")))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(_BUCKETS - 1)), lambda b: F.filter(keys, lambda k: F.pmod(k, F.lit(_BUCKETS)) == b))
    known = _let(buckets, lambda bs: F.filter(hashed, lambda x: F.array_contains(F.get(bs, F.pmod(x["h"], F.lit(_BUCKETS)).cast("int")), x["h"])))
    return F.when(F.size(keys) > 0, known).otherwise(F.expr("cast(array() as array<struct<h: bigint, i: int>>)"))


def find_in_order(paragraphs: DataFrame, prefixes: tuple[int, ...] = (80, 40, 25), least_step: int = 30) -> DataFrame:
    """doc_id, ord, at: where each of ``parts`` starts in ``body`` after the match before it, or null.

    Both are compared in lower case with white space squeezed and straight quotes. The whole part is looked for first, then
    its beginnings of the given lengths; the first place from the cursor on counts, and the cursor moves on by the part's
    length, ``least_step`` at least. ``at`` counts characters of ``body`` as it is: of the first one of the word that the
    match begins in, if lower case changes that word's length.

    All in the row, without a shuffle: one ordered ``aggregate`` over the parts looks each up from the cursor on. Where
    there are over ``_MANY`` parts, which would take the body so many times, one pass hashes the characters at each place
    and keeps places that begin like some part, and equality is tested at these alone. Null and empty parts are not found;
    a null body has no matches; repeated rows are each searched; a document without parts has no rows.
    """
    lengths = sorted(set(prefixes), reverse=True)
    raw = F.coalesce("body", F.lit(""))
    needles = F.transform(F.coalesce("parts", F.array().cast("array<string>")), lambda p: X.normalise_search(F.coalesce(p, F.lit(""))))
    empty = F.expr("cast(array() as array<struct<i: int, fits: int>>)")

    def hits(row: Column, k: int) -> Column:
        size = _KEYS[k]
        own = F.filter(row["needles"], lambda n: (F.length(n) >= size) & (F.length(n) < (_KEYS[k - 1] if k else 1 << 31)))
        keys = F.array_distinct(F.transform(own, lambda n: F.xxhash64(F.substring(n, 1, size))))
        return _let(keys, lambda known: _hits(row["body"], known, size))

    def places(needle: Column, row: Column) -> Column:
        """Structs (i, fits): how many characters of the part's start are at each place, of the lengths that count."""
        def of(k: int) -> Column:
            here = lambda x, n: F.substring(row["body"], x["i"] + 1, n) == F.substring(needle, F.lit(1), n)

            def longest(x: Column) -> Column:
                out = F.when(here(x, F.length(needle)), F.length(needle))
                for n in lengths:
                    out = out.when((F.length(needle) > n) & here(x, F.lit(n)), F.lit(n))
                return out

            mine = _let(F.xxhash64(F.substring(needle, 1, _KEYS[k])), lambda h: F.filter(row[f"hits{k}"], lambda x: x["h"] == h))
            return F.filter(F.transform(mine, lambda x: F.struct(x["i"].alias("i"), longest(x).alias("fits"))), lambda x: x["fits"].isNotNull())

        size = F.length(needle)
        out = F.when(size >= _KEYS[0], of(0))
        for k in range(1, len(_KEYS)):
            out = out.when(size >= _KEYS[k], of(k))
        return F.coalesce(out, empty)

    def step(state: Column, part: Column) -> Column:
        ahead = F.filter(part["places"], lambda x: x["i"] >= state["cursor"])
        first = lambda size: F.array_min(F.transform(F.filter(ahead, lambda x: x["fits"] >= size), lambda x: x["i"]))
        at = F.coalesce(first(part["size"]), *(F.when(part["size"] > n, first(F.lit(n))) for n in lengths))
        return _let(at, lambda a: F.struct(
            F.when(a.isNull(), state["cursor"]).otherwise(a + F.greatest(part["size"], F.lit(least_step))).alias("cursor"), F.array_append(state["at"], a).alias("at"),
        ))

    start = F.struct(F.lit(0).alias("cursor"), F.expr("cast(array() as array<int>)").alias("at"))
    # a place of the squeezed text is a number of words and a place in the next word
    bare = F.ltrim(raw, F.lit(X.WHITE))
    lead = F.length(raw) - F.length(bare)
    # as long as ``bare``, with NULs for a run of white space and a space for its end, so that a word starts after as many spaces
    spaced = F.regexp_replace(F.regexp_replace(bare, "(?U)\\s(?=\\s)", "\0"), "(?U)\\s", " ")

    def original(at: Column, row: Column) -> Column:
        def place(x: Column) -> Column:
            upto = lambda n: F.call_function("substring_index", row["spaced"], F.lit(" "), n)
            begin = F.when(x["word"] > 0, F.length(upto(x["word"])) + 1).otherwise(0)

            def inside(b: Column) -> Column:
                own = F.substring(upto(x["word"] + 1), b + 1, F.length(row["spaced"]))
                return b + F.when(F.length(F.lower(own)) == F.length(own), F.length(F.substring_index(x["before"], " ", -1))).otherwise(0)

            return row["lead"] + _let(begin, inside)

        before = F.substring(row["body"], F.lit(1), at)
        spaces = lambda b: F.length(b) - F.length(F.replace(b, F.lit(" "), F.lit("")))
        return _let(_let(before, lambda b: F.struct(b.alias("before"), spaces(b).alias("word"))), place)

    def by_places(row: Column) -> Column:
        found = F.transform(row["needles"], lambda n: F.struct(F.length(n).alias("size"), places(n, row).alias("places")))
        return F.aggregate(found, start, step, lambda s: s["at"])

    def by_search(row: Column) -> Column:
        def one(state: Column, needle: Column) -> Column:
            size = F.length(needle)
            of = lambda piece: _let(F.position(piece, row["body"], state["cursor"] + 1), lambda p: F.when(p > 0, p - 1))
            at = F.when(size > 0, F.coalesce(of(needle), *(F.when(size > n, of(F.substring(needle, 1, n))) for n in lengths)))
            return _let(at, lambda a: F.struct(
                F.when(a.isNull(), state["cursor"]).otherwise(a + F.greatest(size, F.lit(least_step))).alias("cursor"), F.array_append(state["at"], a).alias("at"),
            ))

        return F.aggregate(row["needles"], start, one, lambda s: s["at"])

    # bound as variables, so that each is made once for a row and not once for each part
    texts = F.struct(X.normalise_search(raw).alias("body"), needles.alias("needles"), spaced.alias("spaced"), lead.alias("lead"), F.length(X.strip(raw)).alias("size"))
    keyed = lambda row: F.struct(row["body"].alias("body"), row["needles"].alias("needles"), *(hits(row, k).alias(f"hits{k}") for k in range(len(_KEYS))))
    chosen = lambda row: F.when(F.size(row["needles"]) > _MANY, _let(keyed(row), by_places)).otherwise(by_search(row))
    # words only grow by lower case and white space only shrinks, to one character; so with the same length nothing has moved
    # (a text in which both happen may have it, too, so white space is compared by itself)
    still = lambda row: (F.length(row["body"]) == row["size"]) & ~F.contains(row["spaced"], F.lit("\0"))
    moved = lambda row, ats: F.transform(ats, lambda a: F.when(a.isNotNull(), original(a, row)))
    at = _let(texts, lambda row: _let(chosen(row), lambda ats: F.when(still(row), F.transform(ats, lambda a: row["lead"] + a)).otherwise(moved(row, ats))))
    # the outer form, since Spark filters by the other's array first, which searches each row once more
    return paragraphs.select("doc_id", F.posexplode_outer(at).alias("ord", "at")).where("ord is not null").select("doc_id", "ord", F.col("at").cast("long").alias("at"))


def segments(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_id, ord, segment: ``body`` from each match to the next, without white space around it."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    ends = found.withColumn("to", F.first("at", ignorenulls=True).over(w)).where("at is not null")
    size = F.coalesce(F.col("to"), F.length("body").cast("long")) - F.col("at")
    cut = F.substring(F.col("body"), (F.col("at") + 1).cast("int"), size.cast("int"))
    return ends.join(bodies.select("doc_id", "body"), "doc_id").select("doc_id", "ord", X.strip(cut).alias("segment"))
