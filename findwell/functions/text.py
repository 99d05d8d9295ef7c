"""String functions as column expressions. A null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Portable between Java and RE2: every Unicode space, not just the ASCII ones.
SPACES = r"[\s\p{Z}\x{85}\x{0B}]+"
# Fixed patterns: what counts as a heading (after #, in a tag, over a line), and the step of the positions of the last two.
HASH_HEADING, TAG_HEADING, LINE_HEADING, HEADING_STEP = r"(?md)^(#{1,6})\s+(.+)$", r"(?i)<h([1-6])[^>]*>([^<]+)</h[1-6]>", r"(?md)^(.+)\n[=\-~^]+\s*$", 100
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _filled(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def preprocess(text) -> Column:
    """One blank for each run of Unicode white space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), SPACES, " "))


def title_for_search(title) -> Column:
    """Underscores as blanks, so that they separate words."""
    return F.replace(col(title), F.lit("_"), F.lit(" "))


def words(text) -> Column:
    """Words between white space."""
    return _filled(F.split(col(text), SPACES))


def query_words(query) -> Column:
    """Words of a query in lower case, duplicates kept."""
    return words(F.lower(col(query)))


def tokens(text, stop_words: list[str] | None = None) -> Column:
    """Index tokens: runs of letters, marks, digits and underscores with inner apostrophes and dots, in lower case."""
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop_words)) if stop_words else found


def plain_words(text) -> Column:
    """Words between blanks, tabs and line feeds only."""
    return _filled(F.split(col(text), "[ \n\t]"))


def first_words(text, n: int) -> Column:
    """The first ``n`` words and dots if there are more."""
    w = words(text)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(col(text))


def truncate(text, most: int) -> Column:
    """At most ``most`` characters, followed by dots if cut; 0 or less leaves the text. Never splits a character."""
    t = col(text)
    return t if most <= 0 else F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)


highlight = truncate


def one_line(text) -> Column:
    """Line feeds and tabs as blanks, none at the ends."""
    return F.trim(F.translate(col(text), "\n\t", "  "))


def _low(text, lowered: bool) -> Column:
    return col(text) if lowered else F.lower(col(text))


# Functions of many terms take ``lowered`` texts as they are: within a lambda nothing is computed just once.


def all_terms_in(terms, text, lowered: bool = False) -> Column:
    """Every term is a substring of the text in lower case; false without terms."""
    low = _low(text, lowered)
    return (F.size(col(terms)) > 0) & F.forall(col(terms), lambda t: F.contains(low, t))


def count_terms_in(terms, text, lowered: bool = False) -> Column:
    """How many of the terms are substrings of the text in lower case."""
    low = _low(text, lowered)
    return F.size(F.filter(col(terms), lambda t: F.contains(low, _low(t, lowered))))


def terms_in_order(terms, text, lowered: bool = False) -> Column:
    """Each term begins after the begin of the one before; true without terms."""
    low = _low(text, lowered)

    def step(at, term):
        found = F.call_function("locate", _low(term, lowered), low, at + 1)
        return F.when(at < 0, F.lit(-1)).otherwise(F.when(found == 0, F.lit(-1)).otherwise(found))

    return F.aggregate(col(terms), F.lit(0), step) >= 0


def phrase_position(phrase, text) -> Column:
    """Character index of the phrase without regard to case, -1 if it isn't there."""
    return F.call_function("instr", F.lower(col(text)), F.lower(col(phrase))) - 1


def occurrences(term, text, lowered: bool = False) -> Column:
    """How often the term stands in the text as a substring, without overlap or regard to case; 0 for an empty term."""
    t, x = _low(term, lowered), _low(text, lowered)
    less = F.length(x) - F.length(F.replace(x, t, F.lit("")))
    return F.when(F.length(t) > 0, F.floor(less / F.length(t))).otherwise(F.lit(0)).cast("int")


def filename_words(name) -> Column:
    """A file name without extension, its ``_ - .`` as blanks, in lower case."""
    return F.lower(F.trim(F.translate(F.regexp_replace(col(name), r"(?s)^(.+)\.[^.]*$", "$1"), "_-.", "   ")))


def extension(name) -> Column:
    """What follows the last dot in lower case; empty without a dot or if it comes first."""
    return F.lower(F.regexp_extract(col(name), r"(?s)^.+\.([^.]*)$", 1))


def has_prefix_word(term, text) -> Column:
    """Any word of the text begins with the term, without regard to case."""
    t = F.lower(col(term))
    return F.exists(words(F.lower(col(text))), lambda w: F.startswith(w, t))


def prefix_words(term, text) -> Column:
    """The words of the text, in lower case, that begin with the term."""
    t = F.lower(col(term))
    return F.filter(words(F.lower(col(text))), lambda w: F.startswith(w, t))


def headers(text) -> Column:
    """Headings of a text as array<struct<level, text, position>>.

    Those after ``#`` with their character index, then those in HTML tags and those over a line of
    ``= - ~ ^``, both with 100 times their number for a position; the last have level 1.
    """
    t = col(text)

    def placed(xs):
        return F.transform(xs, lambda x, i: F.struct(x.level.alias("level"), x.text.alias("text"), (i * HEADING_STEP).alias("position")))

    def made(level, title):
        return F.struct(level.cast("int").alias("level"), F.trim(title).alias("text"))

    pairs = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(HASH_HEADING), F.lit(k)).alias(name) for k, name in ((1, "a"), (2, "b"), (0, "w"))])
    # The place of each is searched from the end of the one before.
    seek = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<level:int,text:string,position:int>>)").alias("xs")),
        lambda s, p: F.struct(
            (F.call_function("locate", p["w"], t, s["at"] + 1) + F.length(p["w"]) - 1).alias("at"),
            F.concat(s["xs"], F.array(F.struct(F.length(p["a"]).alias("level"), F.trim(p["b"]).alias("text"), (F.call_function("locate", p["w"], t, s["at"] + 1) - 1).alias("position")))).alias("xs"),
        ),
        lambda s: s["xs"],
    )
    tagged = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(TAG_HEADING), F.lit(k)).alias(name) for k, name in ((1, "a"), (2, "b"))])
    lined = F.regexp_extract_all(t, F.lit(LINE_HEADING), F.lit(1))
    return F.concat(seek, placed(F.transform(tagged, lambda p: made(p["a"], p["b"]))), placed(F.transform(lined, lambda p: made(F.lit(1), p))))
