"""Line-first quality rules, in built-in functions only.

Each line is judged on its own: navigation strips, boilerplate phrases, symbol noise, shouting,
stuttering words, and scraps without an end mark; a hit counts by the share of the line that it
takes, so that a long paragraph is not lost for one phrase. Failing lines go; a document that loses too
large a share of its words to them is rejected, as is one that fails the base rules on length
or repeated five-word windows. Everything happens inside a row: no shuffle, no Python.

Edge cases: null text has no words and fails; empty text likewise; repeated rows are judged one
by one; lines without a word are neither counted nor judged; ``clean`` passes other
columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.common import fresh, let, quoted

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document is rejected when its failing lines hold more than this share of its words.
MAX_LOST = 0.5
#: A line fails when runs of one word four times or more hold more than this share of it.
MAX_STUTTER = 0.2
#: A line fails when navigation covers more than this share of it.
MAX_NAVIGATION = 0.5
#: A line fails when it has a boilerplate phrase for each so many characters.
BOILERPLATE_CHARS = 100

#: Licence lines are no boilerplate here: they say how a document may be used.
NAVIGATION = r"(?:[|»›•·>][^|»›•·>]{0,40}+){3,}+"
BOILERPLATE = r"(?i)\b(?:cookies?|privacy policy|terms of (?:use|service)|javascript|click here|subscribe|sign (?:up|in)|log ?in|share this|read more)\b"
STUTTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D])){3,}+"
END_MARK = "[.!?…:;\"'”»)\\]]" + r"[\x20\x09-\x0D]*$"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of five that occurs twice or more in the same text."""

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        hit = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
        return let(F.sort_array(F.transform(hit, lambda e: e["p"])), covered)

    def of_hashes(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, p: F.struct(x.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(by_hash, repeated))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) > WINDOW, let(hashes, of_hashes)).otherwise(F.lit(0))

    return let(words, of_words)


def line_passes(line: Column) -> Column:
    """Whether a line that holds a word passes all line rules."""
    n, symbols = n_words(line), F.regexp_count(line, F.lit(SYMBOLS))
    capitals = F.regexp_count(line, F.lit(r"\p{Lu}"))
    scrap = (n <= 3) & ~line.rlike(END_MARK)
    noise = (symbols >= 3) & (symbols * 10 > n)
    shouting = line.rlike("!.*!.*!") & (capitals * 2 > F.length(line))
    stutter = line.rlike(STUTTER) & (F.length(F.regexp_replace(line, STUTTER, "")) < F.length(line) * (1 - MAX_STUTTER))
    navigation = line.rlike(NAVIGATION) & (F.length(F.regexp_replace(line, NAVIGATION, "")) < F.length(line) * (1 - MAX_NAVIGATION))
    boilerplate = line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * BOILERPLATE_CHARS >= F.length(line))
    return ~(scrap | noise | shouting | navigation | boilerplate | stutter)


def judged(docs: DataFrame, text: Column, words: str, lines: str, good: str) -> DataFrame:
    """``docs`` with the words, the lines that hold a word, and those of them that pass."""
    text = F.coalesce(text, F.lit(""))
    out = docs.withColumn(words, words_of(text)).withColumn(lines, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return out.withColumn(good, F.filter(lines, line_passes))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the base counts, base_failed, kept, clean_text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    kept = judged(docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")), F.col("_text"), "_words", "_lines", "_good")
    base = kept.select(
        F.col("_id").alias(id_col),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        n_words(F.array_join("_good", "\n")).cast("long").alias("good_words"),
        F.array_join("_good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    base = base.withColumn("base_failed", failed)
    return base.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("good_words") <= F.col("n_words") * MAX_LOST))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns, with failing lines taken out of the text.

    Rejected rows go by exploding an empty array: a filter would be pushed below the columns it is
    made of, and all rules would be evaluated twice.
    """
    text, (good,) = F.coalesce(quoted(text_col), F.lit("")), fresh(docs, "_good")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = F.struct(words_of(text).alias("words"), F.array_join(F.filter(lines, line_passes), "\n").alias("good"))

    def decided(x: Column) -> Column:
        n, lost = F.size(x["words"]), F.size(x["words"]) - n_words(x["good"])
        keep = (n >= MIN_WORDS) & (repeat_words(x["words"]) * 100 <= n * MAX_REPEAT_PERCENT) & (lost <= n * MAX_LOST)
        return F.when(keep, F.array(x["good"])).otherwise(F.array().cast("array<string>"))

    return docs.withColumn(good, F.explode(let(both, decided))).withColumn(text_col, quoted(good)).select(*map(quoted, docs.columns))
