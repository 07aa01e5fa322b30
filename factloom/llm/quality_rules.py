"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

``THRESHOLDS`` names a measure, its least and greatest allowed value (None: open); :func:`quality_rules` turns the rows into one
boolean expression. A document is kept when the base test passes and every measure lies within its bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_names

SPACES = " \t\n\x0b\x0c\r"
#: So many repeated windows are looked up one by one.
FEW = 12
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and a in to is was that for on with as are be this by it from at or an "
    "der die und das den von zu mit dem des im ist ein eine auf für nicht sich es "
    "le la les de et des un une que pour dans est sur pas au par qui avec "
    "el los las del y en por con para su se lo al como más"
).split()
#: measure, least, greatest
THRESHOLDS = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.3),
    ("exclaims_per_word", None, 0.5),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)
BASE_WORDS, BASE_REPEAT_PERCENT = 50, 50


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def window_hashes(words: Column) -> Column:
    """A 64-bit hash for each window of three words."""
    short = F.array().cast("array<bigint>")
    return F.when(F.size(words) < 3, short).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def twice(ordered: Column) -> Column:
    """The values that occur twice or more in a sorted array."""
    at = F.sequence(F.lit(1), F.size(ordered) - 1)
    none = F.array().cast("array<bigint>")
    return F.when(F.size(ordered) < 2, none).otherwise(F.array_distinct(F.transform(F.filter(at, lambda i: F.get(ordered, i) == F.get(ordered, i - 1)), lambda i: F.get(ordered, i))))


def covered(hashes: Column, repeated: Column, few_at_most: int = FEW) -> Column:
    """Words that lie in a window whose hash is in ``repeated``: the sum over such windows, in order, of what each adds behind the one before.

    With few repeated hashes each window looks its hash up among them; with many, windows sorted by hash are compared with their neighbours.
    """
    at = F.sequence(F.lit(0), F.size(hashes) - 1)
    few = F.filter(at, lambda i: F.array_contains(repeated, F.get(hashes, i)))

    def neighbours(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        found = F.filter(at, lambda i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < F.size(s) - 1) & same(i, F.least(i + 1, F.size(s) - 1))))
        return F.sort_array(F.transform(found, lambda i: F.get(s, i)["i"]))

    many = let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), neighbours)
    starts = F.when(F.size(repeated) <= few_at_most, few).otherwise(many)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    total = F.aggregate(starts, start, lambda a, s: F.struct((s + 3).alias("end"), (a["n"] + F.least(F.lit(3), s + 3 - a["end"])).alias("n")), lambda a: a["n"].cast("long"))
    return F.when(F.size(repeated) == 0, F.lit(0).cast("long")).otherwise(total)


def compile_rules(thresholds, of: dict[str, Column]) -> Column:
    """One boolean expression from the rows of ``thresholds``."""
    passed = F.lit(True)
    for name, least, most in thresholds:
        passed = passed & (F.lit(True) if least is None else of[name] >= least) & (F.lit(True) if most is None else of[name] <= most)
    return passed


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS, into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: the counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base test. All columns of ``docs`` stay, whatever their names, ``into`` apart, which is replaced.
    Rows are independent: repeated rows get equal results, and an empty table gives an empty one. Texts of any length are read whole.
    """
    c = F.col
    t = F.coalesce(c(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    # what is used often is projected once, in columns that go again
    own = [x for x in docs.columns if x.lower() != into.lower()]
    w, l_, joined, h, s, r, m_ = free_names([*own, into], "words", "lines", "joined", "hashes", "sorted", "repeated", "counts")
    d = docs.select(*[c(f"`{x}`") for x in own], words_of(c(text)).alias(w), lines.alias(l_))
    d = d.withColumn(joined, F.array_join(w, "")).withColumn(h, window_hashes(c(w)))
    # sorted only where some window repeats
    none = F.array().cast("array<bigint>")
    d = d.withColumn(s, F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.sort_array(h)))
    d = d.withColumn(r, twice(c(s))).drop(s)
    both = [*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]
    long = lambda x: x.cast("long")
    counts = {
        "n_words": long(F.size(w)),
        "word_chars": long(F.length(joined)),
        "n_symbols": long(F.octet_length(joined) - F.octet_length(F.regexp_replace(joined, f"[{SYMBOLS}]+", ""))),
        "n_dup_lines": long(F.size(l_) - F.size(F.array_distinct(l_))),
        "n_repeat_words": covered(c(h), c(r)),
        "n_lines": long(F.size(l_)),
        "n_exclaims": long(F.octet_length(joined) - F.octet_length(without(c(joined), "!"))),
        "n_stop_words": long(F.size(F.filter(w, lambda x: x.isin(both)))),
    }
    d = d.withColumn(m_, F.struct(*[x.alias(k) for k, x in counts.items()])).drop(w, l_, joined, h, r)
    m = c(m_)
    ratio = lambda a, b: m[a] / F.greatest(m[b], F.lit(1))
    of = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "exclaims_per_word": ratio("n_exclaims", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }
    failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = F.struct(*[m[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & compile_rules(thresholds, of)).alias("kept"))
    return d.withColumn(into, judged).drop(m_)
