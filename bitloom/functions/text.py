"""Text predicates and clean-ups as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Line terminators, character classes and markers that results depend on.
LINE_END = "\\r\\n|[\\n\\r\\x{0B}\\x{0C}\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CJK_LEAK = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{2FFFF}\\x{30000}-\\x{323AF}]"
CJK_BASIC = "[\\x{4E00}-\\x{9FFF}]"
CJK_WIDE = "[\\x{3400}-\\x{9FFF}]"
CJK_TWO_BLOCKS = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]"
CJK_BODY = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{F900}-\\x{FAFF}]"
ANCHOR = "\\{#[^{}\\n]*\\}"
LINK_DESTINATION = "(?<=\\])\\([^()\\n]*\\)"
SECTION_NUMBER = "[一二三四五六七八九十]+[、，,]"
ITEM_NUMBER = "\\d+[、.,]"
DOT_LEADER = "\\.{3,}"
PAGE_NUMBER = "\\d{1,3}"
CHINESE_PUNCTUATION = "[，。、；：？！《》【】（）]"
EMPHASIS = "\\*[^*\\n]+\\*"
COMMENT = "\\{%|%\\}"
TITLE_MARKER = "(?U)^\\s*(?:#{1,6}\\s+|-\\s+)"
TITLE_NUMBER = "(?iU)^(?:[一二三四五六七八九十百]+[、．.]|\\d+[．.]|[IVXLCDM]+[.)])\\s*"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_lines(text: Column | str) -> Column:
    """Lines without terminators; a final terminator adds no line and an empty text has none. Null stays null."""
    t = as_column(text)
    return F.when(t == "", F.array().cast("array<string>")).when(t.isNotNull(), F.split(F.regexp_replace(t, f"(?:{LINE_END})\\z", ""), LINE_END, -1))


def is_blank(line: Column | str) -> Column:
    """Only white space of any script, or nothing."""
    return ~as_column(line).rlike(f"[^{WHITE}]")


def strip(text: Column | str) -> Column:
    """Without leading and trailing white space of any script."""
    return F.btrim(as_column(text), F.lit(WHITE))


def squeeze(text: Column | str) -> Column:
    """White-space runs become one space; none at the ends."""
    return strip(F.regexp_replace(as_column(text), "(?U)\\s+", " "))


def heading_level(line: Column | str) -> Column:
    """1 to 6, or 0 for a line that isn't a heading."""
    t = as_column(line)
    return F.when(t.startswith("#"), F.length(F.regexp_extract(t, "(?U)^(#{1,6})(?:\\s|$)", 1))).when(t.isNotNull(), 0)


def emphasis_count(line: Column | str) -> Column:
    t = as_column(line)
    return F.when(t.contains("*"), F.regexp_count(t, F.lit(EMPHASIS))).when(t.isNotNull(), 0)


def comment_tokens(text: Column | str) -> Column:
    t = as_column(text)
    return F.when(t.contains("%"), F.regexp_extract_all(t, F.lit(COMMENT), F.lit(0))).when(t.isNotNull(), F.array().cast("array<string>"))


def strip_structure(text: Column | str) -> Column:
    """Without ``{#anchors}`` and link destinations."""
    t = as_column(text)
    bare = F.regexp_replace(F.regexp_replace(t, ANCHOR, ""), LINK_DESTINATION, "")
    return F.when(t.contains("{#") | t.contains("]"), bare).otherwise(t)


def _outside(line: Column | str, allowed: tuple[str, ...]) -> Column:
    """A line without structure and allowed strings."""
    t = strip_structure(line)
    for s in allowed:
        t = F.replace(t, F.lit(s), F.lit(""))
    return t


def is_title_line(line: Column | str) -> Column:
    return (heading_level(line) > 0) | as_column(line).rlike(TITLE_MARKER)


def title_key(line: Column | str) -> Column:
    """A title without marker and number, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(as_column(line), TITLE_MARKER, ""), TITLE_NUMBER, ""))


def has_cjk_leak(line: Column | str, allowed: tuple[str, ...] = ()) -> Column:
    """Chinese characters left after structure and allowed strings are taken out."""
    return _outside(line, allowed).rlike(CJK_LEAK)


def has_punctuation_leak(line: Column | str, allowed: tuple[str, ...] = ()) -> Column:
    """Chinese punctuation left after structure and allowed strings are taken out."""
    return _outside(line, allowed).rlike(CHINESE_PUNCTUATION)


def has_bold(line: Column | str) -> Column:
    return as_column(line).contains("**")


def paragraph_count(lines: Column) -> Column:
    """Blocks of non-blank lines."""
    return F.size(F.filter(lines, lambda x, i: ~is_blank(x) & ((i == 0) | is_blank(F.get(lines, i - 1)))))


def fold_ascii(text: Column | str) -> Column:
    """A to Z in lower case and nothing else changed."""
    return F.translate(as_column(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_like(text: Column | str, token: str) -> Column:
    """SQLite's ``LIKE '%token%'``: ASCII case is folded; % and _ in the token are wild cards."""
    pattern = token.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).replace("\\", "\\\\")
    return fold_ascii(text).like(f"%{pattern}%")


def is_analytic_chinese(text: Column | str) -> Column:
    """Has Chinese characters and fewer than eight English words."""
    t = as_column(text)
    return t.rlike(CJK_TWO_BLOCKS) & (F.regexp_count(t, F.lit("[A-Za-z]+(?:['-][A-Za-z]+)*")) < 8)


def folded(text: Column | str) -> Column:
    """A text in the form in which texts are equal that differ in letter case only (``Straße`` and ``STRASSE``)."""
    # capitals take letters apart that lower case leaves (ß, ligatures); capital ß and dotless i have none of their own, and final sigma is a sigma
    kept = F.translate(as_column(text), "\u0131\u1e9e", "\ue000\u00df")
    # the optimizer takes lower(upper(x)) for lower(x), which it isn't, so the two are kept apart
    capitals = F.translate(F.upper(kept), "\u03c2", "\u03a3")
    return F.translate(F.lower(capitals), "\u03c2", "\u03c3")


def same_folded(a: Column | str, b: Column | str) -> Column:
    return folded(a) == folded(b)


def normalise_search(text: Column | str) -> Column:
    """Lower case, squeezed white space, straight quotes."""
    return F.lower(F.translate(squeeze(text), "“”‘’", "\"\"''"))


def normalise_eol(text: Column | str) -> Column:
    """CRLF and CR become LF; NUL is an error; one final LF."""
    t = as_column(text)
    checked = F.when(F.instr(t, "\0") > 0, F.raise_error(F.lit("the text holds NUL"))).otherwise(F.regexp_replace(t, "\\r\\n?", "\n"))
    return F.concat(F.regexp_replace(checked, "\\n+\\z", ""), F.lit("\n"))


def sentence_pieces(text: Column | str) -> Column:
    """All sentences, white space squeezed."""
    return F.split(squeeze(text), "(?<=[.!?\"”])\\s+")


def sentences(text: Column | str, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters."""
    return F.filter(sentence_pieces(text), lambda s: F.length(s) >= least)


def word_differences(a: Column | str, b: Column | str) -> Column:
    """Positions where two texts' words differ, as structs (i, a, b); a missing word is null."""
    pairs = F.arrays_zip(F.split(squeeze(a), " ").alias("a"), F.split(squeeze(b), " ").alias("b"))
    numbered = F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["a"].alias("a"), p["b"].alias("b")))
    return F.filter(numbered, lambda p: ~p["a"].eqNullSafe(p["b"]))


def sha256_hex(text: Column | str) -> Column:
    return F.sha2(F.encode(as_column(text), "utf-8"), 256)


def is_hex64(text: Column | str) -> Column:
    return as_column(text).rlike("\\A[0-9a-f]{64}\\z")


def is_line_id(text: Column | str) -> Column:
    return as_column(text).rlike("\\AL[1-9][0-9]*\\z")


def is_offset_datetime(text: Column | str) -> Column:
    """A valid RFC 3339 date-time with an offset."""
    t = as_column(text)
    return t.rlike("\\A\\d{4}-\\d{2}-\\d{2}[Tt]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:[Zz]|[+-]\\d{2}:\\d{2})\\z") & F.try_to_timestamp(t).isNotNull()


def glossary_blocks(text: Column | str) -> Column:
    """Terms of ``{% "TERM" ... %}`` blocks."""
    return F.regexp_extract_all(as_column(text), F.lit("\\{%\\s*\"([^\"]+)\""), F.lit(1))


def clean_markdown(text: Column | str) -> Column:
    """Without links-only table-of-contents lines and heading ids."""
    t = F.regexp_replace(as_column(text), "(?m)^\\s*(?:[-*]|\\d+\\.)?\\s*\\[[^\\]]*\\]\\(#[^)]*\\)\\s*\\n?", "")
    return F.regexp_replace(t, "[ \\t]*\\{#[^}]*\\}", "")


# Places that lack a space, after which the captures go with one between them.
TIGHT = (("(\\d)\\.([A-Z][a-z])", "$1. $2"), ("(said|says),\"", "$1, \""), ("\\.([A-Z][a-z])", ". $1"))
# Where English begins after Chinese, and the ends of an entry's Chinese part.
TURN = "[\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}](?U:\\s*)\\**(?U:\\s*)(?=[A-Za-z])"
ENTRY = "\\A(?U)(.+[\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}）)])\\s+([A-Z].+)\\z"


def fix_typesetting(text: Column | str) -> Column:
    """``2.How``, ``said,"`` and ``end.Then`` get their space."""
    t = as_column(text)
    for place, with_space in TIGHT:
        t = F.regexp_replace(t, place, with_space)
    return t


def without_anchors(text: Column | str) -> Column:
    """Without ``{#anchors}``, and links as their words."""
    return F.regexp_replace(F.regexp_replace(as_column(text), "\\{#[^}]*\\}", ""), "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")


def split_mixed(text: Column | str) -> Column:
    """(cn, en) of a line that holds Chinese and then English, anchors and links taken out; a line of one language, or with Chinese after its English, is one side (the other null)."""
    t = strip(without_anchors(text))
    before = F.length(F.regexp_extract(t, f"(?s)\\A(?:(?!{TURN}).)*+{TURN}", 0))
    en = strip(F.substring(t, before + 1, F.length(t)))
    cn = strip(F.regexp_replace(F.substring(t, F.lit(1), before), "[* ]+\\z", ""))
    splits = (before > 0) & ~en.rlike(CJK_BASIC)
    return F.when(splits, F.struct(cn.alias("cn"), en.alias("en"))).otherwise(F.struct(F.when(t.rlike(CJK_BASIC), t).alias("cn"), F.when(~t.rlike(CJK_BASIC), t).alias("en")))


def clean_cn(text: Column | str) -> Column:
    """A Chinese title or paragraph without its number, heading marks, stars and page."""
    t = as_column(text)
    for mark in ("\\A\\d+\\.(?U:\\s*)", "\\A#+(?U:\\s*)\\**", "\\**(?U:\\s*)\\z", "\\t\\d+\\z"):
        t = F.regexp_replace(t, mark, "")
    return strip(t)


def clean_en(text: Column | str) -> Column:
    """An English line without its number and the stars at its end."""
    return strip(F.regexp_replace(F.regexp_replace(as_column(text), "\\A\\d+[、,.](?U:\\s*)", ""), "\\*+\\z", ""))


def split_entry(line: Column | str) -> Column:
    """(cn, en) of a contents entry with both titles, its page taken off; both null for anything else."""
    t = F.regexp_replace(strip(line), "(?U)\\s+\\d+\\s*\\z", "")
    part = lambda k: F.when(t.rlike(ENTRY), strip(F.regexp_extract(t, ENTRY, k)))
    return F.struct(part(1).alias("cn"), part(2).alias("en"))


def split_toc(line: Column | str) -> Column:
    """(title, page) of ``Title ..... 12``; page is null without one."""
    t = as_column(line)
    m = "\\A(.*?)[\\s.·…]{2,}(\\d+)\\s*\\z"
    return F.struct(strip(F.when(t.rlike(m), F.regexp_extract(t, m, 1)).otherwise(t)).alias("title"), F.when(t.rlike(m), F.regexp_extract(t, m, 2).cast("int")).alias("page"))


def split_compact_list(line: Column | str) -> Column:
    """Items of ``1. a 2. b 3. c``; a line with fewer than two items stays whole."""
    t = as_column(line)
    items = F.filter(F.split(t, "(?<=\\S)\\s+(?=\\d{1,2}[.)]\\s)"), lambda x: strip(x) != "")
    return F.when(F.regexp_count(t, F.lit("(?:^|\\s)\\d{1,2}[.)]\\s")) >= 2, items).otherwise(F.array(t))


def split_steps(line: Column | str) -> Column:
    """Parts of a line at Chinese step markers (第一步, 一、 ...)."""
    return F.filter(F.split(as_column(line), "(?<=\\S)\\s*(?=第[一二三四五六七八九十]+步)"), lambda x: strip(x) != "")


def is_page_number(line: Column | str) -> Column:
    return strip(line).rlike("\\A\\d{1,2}\\z")


def is_vertical_toc(line: Column | str) -> Column:
    s = strip(line)
    return (F.length(s) == 1) & s.rlike("[\\x{4E00}-\\x{9FFF}\\d【】·，。、；：？！《》（）]")


def is_section_header(line: Column | str) -> Column:
    """A title in lenticular brackets, a ``#`` heading, or a line that opens with a number and its mark."""
    s = strip(line)
    return s.rlike(f"\\A(?:【.*】\\z|#|{SECTION_NUMBER}|{ITEM_NUMBER})")


def is_outline_toc(line: Column | str) -> Column:
    """A dot leader, or a numbered entry of under 30 characters."""
    s = strip(line)
    entry = s.rlike(f"\\A(?:{SECTION_NUMBER}|{ITEM_NUMBER})\\s*\\S")
    return s.rlike(DOT_LEADER) | entry & (F.length(s) < 30)


def is_pdf_noise(line: Column | str, running_heads: tuple[str, ...] = ()) -> Column:
    """Empty lines, page numbers, typesetter slugs and given running heads."""
    s = strip(line)
    noise = (s == "") | s.rlike(f"\\A{PAGE_NUMBER}\\z") | s.rlike("(?i)\\.indd\\b|\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\s+\\d{1,2}:\\d{2}")
    return noise | s.isin(*running_heads) if running_heads else noise
