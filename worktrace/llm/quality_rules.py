"""Quality rules [native]: rules per line first, then a verdict on what is left of the document.

Every line of a document is judged alone: by its end mark, by navigation separators, by boilerplate phrases, by
symbols and by capitals. Lines that fail are removed; a document that loses more than half of its characters is
rejected. Base statistics over the whole text go before that verdict.

All work stays in one row: no shuffle, no Python. A null or empty text has no words and fails the base rules; very long texts are
judged whole; repeated rows and ties are judged alike, row by row, also where they share an id; an empty table gives an empty
result; further columns are passed through only by ``clean_lines``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import quoted, words

WINDOW = 5  # the hashes below join a word with 1, 2 and 1 more
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_KEPT_SHARE = 0.5
SYMBOLS = r"[#*$%&|<>]"

# Prose has a mark that ends a sentence, perhaps followed by a closing quote or bracket; a cut last sentence is forgiven.
# After an ideographic mark, no space is due.
END_MARK = r"[.!?;:\x{2026}\x{061F}\x{06D4}\x{0964}]['\x22)\]\x{201D}\x{2019}\x{00BB}]?([\x20\x09-\x0D]|$)|[\x{3002}\x{FF01}\x{FF1F}]"
LETTER = r"[\p{Ll}\p{Lo}]"  # a lower-case one, or one of a script without cases
MARKS = r"[#*$%&|<>\x{00BB}\x{203A}\x{2022}]"
NAVIGATION = r"([|>\x{00BB}\x{203A}\x{2022}][^|>\x{00BB}\x{203A}\x{2022}]*){3}"
BOILERPLATE_SPAN = 300  # characters of a line for which one phrase is too many
BOILERPLATE = [
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "javascript",
    "subscribe to", "sign up for", "click here", "copyright", "licensed under", "released under the",
]


def without(text: Column, pattern: str) -> Column:
    """Length of ``text`` without what ``pattern`` matches."""
    return F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """True where a line breaks a rule; a line of any length may have fewer boilerplate phrases than one in ``BOILERPLATE_SPAN`` characters."""
    marks = F.length(line) - without(line, MARKS)
    phrase = reduce(lambda a, b: a | b, [F.lower(line).contains(x) for x in BOILERPLATE])
    count = F.regexp_count(F.lower(line), F.lit("|".join(BOILERPLATE)))
    return (
        ~line.rlike(END_MARK)
        | ~line.rlike(LETTER)
        | (marks * 20 > F.length(line))
        | (line.contains("|") & line.rlike(NAVIGATION))
        | F.when(phrase, count * BOILERPLATE_SPAN >= F.length(line)).otherwise(False)
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all lines, the kept lines and the row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"), F.struct(*quoted(docs.columns)).alias("row")).withColumn("w", words(F.col("text")))
    out = out.select(
        "doc_id",
        "row",
        F.size("w").alias("n_words"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).alias("n_symbols"),
    )
    pairs = lambda c, k: F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + k)))
    out = out.withColumn("g", pairs("w", 1))
    out = out.withColumn("g", pairs("g", 2))
    grams = F.transform("g", lambda x, i: F.xxhash64(x, F.get("w", i + WINDOW - 1)))
    out = out.withColumn("g", F.when(F.col("n_words") >= WINDOW, F.slice(grams, 1, F.col("n_words") - WINDOW + 1)))
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    out = out.withColumn("s", F.when(repeats, F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    starts = F.sort_array(
        F.transform(
            F.filter(
                "s",
                lambda x, i: same(F.get("s", i + 1)["h"], x["h"]) | (same(F.get("s", F.greatest(i - 1, F.lit(0)))["h"], x["h"]) & (i > 0)),
            ),
            lambda x: x["i"],
        )
    )
    out = out.withColumn("s", starts)
    covered = F.aggregate(
        F.transform("s", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("s", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return out.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "lines",
        F.filter("lines", lambda x: ~line_fails(x)).alias("good_lines"),
        "row",
    )


def judge(docs: DataFrame, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """Statistics, verdicts, the cleaned text (``clean_text``) and the row itself (``row``) of every document."""
    chars = lambda lines: F.length(F.array_join(lines, ""))
    s = statistics(docs)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return s.select(
        *s.columns[:6],
        base_failed.alias("base_failed"),
        (~base_failed & (chars("good_lines") >= min_kept_share * chars("lines"))).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good_lines")).cast("long").alias("n_removed_lines"),
        F.array_join("good_lines", "\n").alias("clean_text"),
        "row",
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected documents, their texts without failed lines; other columns stay as they are."""
    return judge(docs).where("kept").select(*[(F.col("clean_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
