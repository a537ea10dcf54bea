"""Operator 10, quality rules: line-first cleaning, by Spark expressions only.

Every line is judged: by its punctuation and capitals, as navigation, as boilerplate. What decides in any language is
the line's form: symbols, separators, one word over and over, capitals, and runs of short lines that no mark ends, as
menus have; the English phrases and menu words below add to that. Lines that fail are removed; a document that loses too
much of its text, or that fails the rules on whole texts, is rejected.

Lines are not counted across documents: copies and near copies, which a later stage thins out to one, would all lose
their lines and go together.

Defined results: a null or empty text has no words, so it fails ``base_failed``; null in other columns is passed
through; repeated rows give repeated results; an empty table gives an empty table. The operator keeps the caller's
columns and puts its own into one struct column, whose name the caller can choose, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, n_words, words

WINDOW = 8
SYMBOL = "[#*$%&|<>]"
MARK = "[|»›•·]"
#: How a line ends that is no menu item.
ENDED = "[.!?:;…。！？।؟][^\\p{L}\\p{N}]*$"
CAPITALS = r"\p{Lu}\p{Lu}"
#: Phrases that mark a line as boilerplate, where the line is short.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "terms and conditions",
    "accept cookies", "accept all cookies", "uses cookies", "subscribe to our newsletter", "sign up for our newsletter",
    "enable javascript", "javascript is disabled", "click here to", "powered by", "lorem ipsum",
)
#: Whole lines, in lower case and without marks at their ends, that are navigation.
NAVIGATION = (
    "home", "menu", "next", "previous", "prev", "back", "back to top", "top", "login", "log in", "sign in", "sign up",
    "register", "search", "share", "print", "contact", "contact us", "about", "about us", "read more", "more", "skip to content",
)


@dataclass(frozen=True)
class Rules:
    """The limits. Shares are of the characters in words."""

    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line with at least so many marks such as # or * for every hundred words fails.
    max_symbols_percent: int = 100
    #: A line in which more than this percent of the words equal the word before fails.
    max_stutter_percent: int = 30
    #: A boilerplate phrase counts in lines of at most so many words.
    boilerplate_words: int = 25
    #: A navigation line: separators such as | or » between items, at least so many of them and at most so many words an item.
    nav_marks: int = 2
    nav_words: int = 3
    #: A line of so many words, with two capitals side by side, fails if more than this percent of its letters are capitals.
    capital_words: int = 4
    max_capitals_percent: int = 60
    #: Three and more lines on end fail of at most so many words each, none of which ends in a mark.
    run_words: int = 3
    #: A document that keeps less than this percent of its characters in words is rejected.
    min_kept_percent: int = 50


def _chars(ws: Column) -> Column:
    """How many code points are in these words."""
    return F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))


def repeat_words(ws: Column) -> Column:
    """How many words lie in windows of eight words that occur twice or more among the words, the first one included.

    A window's 64-bit hash is built by doubling: of two neighbours, of four, of eight words. The hashes are sorted
    with their places; places whose hash has an equal neighbour are sorted again, and what they cover is summed.
    That is n log n in the words of one text, and the sorting only happens where a hash occurs twice.
    """

    def pair(by: int):
        return lambda h: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))

    def covered(starts: Column) -> Column:
        steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda x, y: F.least(y - x, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(WINDOW)))

    def doubled(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(rows: Column) -> Column:
            # a place is flagged with the next one of equal hash: both ends of every equal step
            steps = F.zip_with(rows, F.slice(rows, 2, F.size(rows)), lambda r, n: F.when(r["h"] == n["h"], F.array(r["i"], n["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(steps, lambda x: x.isNotNull()))))

        return let(let(pairs, flagged), covered)

    def eights(h8: Column) -> Column:
        h = F.slice(h8, 1, F.size(h8) - (WINDOW - 1))
        return let(h, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), doubled(h)).otherwise(0))

    def hashed(ws: Column) -> Column:
        return let(let(let(F.transform(ws, lambda w: F.xxhash64(w)), pair(1)), pair(2)), pair(4))

    return F.when(F.size(ws) > WINDOW, let(hashed(ws), eights)).otherwise(0).cast("long")


def _left(text: Column, kinds: str) -> Column:
    """How many characters are of these kinds."""
    return F.length(F.regexp_replace(text, rf"[^{kinds}]+", ""))


def _in_runs(lines: Column, rules: Rules) -> Column:
    """For each line whether it is one of three or more short lines on end."""

    def runs(short: Column) -> Column:
        at = lambda k: F.coalesce(F.get(short, k), F.lit(False))
        three = lambda i: (at(i - 1) & (at(i - 2) | at(i + 1))) | (at(i + 1) & at(i + 2))
        return F.when(F.exists(short, lambda s: s), F.transform(short, lambda s, i: s & three(i))).otherwise(short)

    few = lambda x: (F.length(x) <= 200) & (n_words(x) <= rules.run_words) & F.rlike(x, F.lit(r"\p{L}")) & ~F.rlike(x, F.lit(ENDED))
    return let(F.transform(lines, few), runs)


def _bad_line(line: Column, suspect: Column, rules: Rules) -> Column:
    """Whether a line with words fails: no letters, marks instead of letters, navigation, boilerplate, or one word over and over.

    ``suspect``: the document has symbols or doubled words at all. Without them, and without a mark or a phrase in the
    line, the tests that take the line apart cannot fail and are not run.
    """

    def apart(low: Column, phrase: Column):
        def judged(ws: Column) -> Column:
            few = F.size(ws)
            symbols = _symbols(low)
            marks = F.length(low) - F.length(F.regexp_replace(low, MARK, ""))
            same = F.filter(F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: a == b), lambda x: x)
            punctuation = (symbols * 100 >= few * rules.max_symbols_percent) & (symbols > 2)
            navigation = (marks >= rules.nav_marks) & (few <= (marks + 1) * (rules.nav_words + 1))
            return punctuation | navigation | ((few <= rules.boilerplate_words) & phrase) | (F.size(same) * 100 > few * rules.max_stutter_percent)

        return judged

    def judged(low: Column) -> Column:
        phrase = F.lit(False)
        for p in BOILERPLATE:
            phrase = phrase | F.contains(low, F.lit(p))
        item = F.regexp_replace(low, r"^[^\p{L}]++|[^\p{L}]++$", "")
        return (
            F.when(~F.rlike(low, F.lit(r"\p{L}")), True)
            .when((F.length(low) <= 60) & item.isin(*NAVIGATION), True)
            .when(F.rlike(line, F.lit(CAPITALS)) & (n_words(line) >= rules.capital_words) & (_left(line, r"\p{Lu}") * 100 > _left(line, r"\p{Lu}\p{Ll}") * rules.max_capitals_percent), True)
            .when(suspect | F.rlike(low, F.lit(MARK)) | phrase, let(words(line), apart(low, phrase)))
            .otherwise(False)
        )

    return let(F.lower(line), judged)


def verdict(text: Column, rules: Rules = Rules()) -> Column:
    """Of one text: the counts, the cleaned text, and the verdicts ``base_failed`` and ``kept``, as a struct."""
    whole = F.coalesce(text, F.lit(""))
    blank = lambda line: F.trim(line, F.lit(BLANKS)) == ""

    def of_words(ws: Column) -> Column:
        same = F.exists(F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))
        return F.struct(F.size(ws).cast("long").alias("n"), _chars(ws).cast("long").alias("chars"), repeat_words(ws).alias("repeats"), same.alias("same"))

    def of_lines(suspect: Column):
        def both(lines: Column) -> Column:
            full = F.filter(lines, lambda x: ~blank(x))
            twice = let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            clean = let(_in_runs(lines, rules), lambda runs: F.filter(lines, lambda x, i: blank(x) | ~(F.get(runs, i) | _bad_line(x, suspect, rules))))
            return F.struct(twice.alias("twice"), let(clean, lambda c: F.struct(F.array_join(c, "\n").alias("text"), (F.size(c) < F.size(lines)).alias("less"))).alias("clean"))

        return both

    def measured(t: Column) -> Column:
        parts = F.struct(t.alias("t"), let(words(t), of_words).alias("w"), _symbols(t).cast("long").alias("n_symbols"))
        return let(parts, lambda m: F.struct(m["w"].alias("w"), m["n_symbols"].alias("n_symbols"), let(F.split(m["t"], "\n"), of_lines(m["w"]["same"] | (m["n_symbols"] > 0))).alias("lines")))

    def judged(m: Column) -> Column:
        failed = (m["w"]["n"] < rules.min_words) | (m["w"]["repeats"] * 100 > m["w"]["n"] * rules.max_repeat_percent)
        left = ~m["lines"]["clean"]["less"] | (let(words(m["lines"]["clean"]["text"]), _chars) * 100 >= m["w"]["chars"] * rules.min_kept_percent)
        return F.struct(
            m["w"]["n"].alias("n_words"),
            m["w"]["chars"].alias("word_chars"),
            m["n_symbols"].alias("n_symbols"),
            m["lines"]["twice"].alias("n_dup_lines"),
            m["w"]["repeats"].alias("n_repeat_words"),
            m["lines"]["clean"]["text"].alias("clean_text"),
            failed.alias("base_failed"),
            (~failed & left).alias("kept"),
        )

    return let(let(whole, measured), judged)


def judge(docs: DataFrame, text: str = "text", out: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the verdicts on their texts in the struct column ``out``."""
    return docs.withColumn(out, verdict(docs[text], rules))


def passed(docs: DataFrame, text: str = "text", out: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """``judge``, and only the rows that are kept.

    A filter on the verdict would be moved below it and judge every text a second time; a list of one that is emptied
    does not.
    """
    one = F.filter(F.array(verdict(F.col(text), rules)), lambda q: q["kept"])
    return docs.select(*(c for c in docs.columns if c != out), F.explode(one).alias(out))
