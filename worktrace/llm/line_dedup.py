"""Line dedup [native]: hashes of least windows of units (lines, cut at sentence ends), and deletion of later repeated runs.

1. A document is a list of units: its lines, cut after sentence ends, since pages are often one line and share sentences.
   A run of units (blank ones do not count) that the same document or an earlier one has before is deleted where it has
   ``MIN_WORDS`` words or more, with the blank units that follow it.
2. Of each unit, the shortest run from it and the shortest run up to it that have ``MIN_WORDS`` words are its windows.
   Every repeated run is the union of the windows inside it, and each of them is repeated; so units are deleted exactly
   where one of their windows has occurred before. No two documents are compared with each other.
3. A window is hashed as a whole (64 bits, as units are), and every place of a hash but its first in the corpus is deleted.
   The few hashes that have more than one in ``HOT`` of all places are looked up by broadcast, so that no task gets all places
   of a hash; there are fewer than ``HOT`` of them, whatever the size of the corpus.

Fingerprints that are minima of such windows (winnowing) would have to be joined with all places of a hash to find every repeat,
which is all pairs of a group; with first places only, repeats behind partial earlier copies are lost.

The order of documents is that of doc_id, then of a hash of the text. Null texts stay null, empty ones empty; null ids
come last in order and are handled like others; rows repeated in full are cleaned alike (their copies count as one
document); ties do not occur beyond that; very long texts are taken whole; an empty table gives an empty result; further columns
stay, whatever their names, but for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import quoted, stored

MIN_WORDS = 30
HOT = 1000
#: Units end here; ``units`` gives the same by plain replacements, which are faster than a pattern.
UNIT_ENDS = r"(?<=\n)|(?<=[.!?] )(?=[^ \n])"
_SENTENCE_ENDS = (". ", "! ", "? ")
_CUT, _ESCAPE = "\x01", "\x02"
_BLOCK = 512  # units of a document whose windows are joined in one group


def _replace(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _cut(text: Column, line_end: str = "\n" + _CUT) -> Column:
    """``text`` with a mark at the end of every unit, ``line_end`` for a line feed; marks of its own are escaped."""
    text = _replace(F.coalesce(text, F.lit("")), (_ESCAPE, _ESCAPE + "b"), (_CUT, _ESCAPE + "a"))
    text = _replace(text, *[(x, x + _CUT) for x in _SENTENCE_ENDS], (_CUT + " ", " "), (_CUT + "\n", "\n"))
    return _replace(F.rtrim(text, F.lit(_CUT)), ("\n", line_end))


def _uncut(text: Column) -> Column:
    return _replace(text, (_ESCAPE + "a", _CUT), (_ESCAPE + "b", _ESCAPE))


def units(text: Column) -> Column:
    """Lines cut at sentence ends, with the white space that follows them (escaped: ``_uncut`` of their concatenation is the text)."""
    return F.split(_cut(text), _CUT)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value made once; a column named inside a lambda may be made again for every entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bare_units(text: Column) -> Column:
    """(i: place, u: hash of the words in lower case, n: words, up to MIN_WORDS, by spaces, tabs and line ends) of the units that are not blank, and the number of all units."""
    plain = _replace(F.lower(_cut(text, _CUT)), ("\r", " "), ("\t", " "))
    plain = _let(plain, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " {2,}", " ")).otherwise(x))
    n_words = lambda x: F.when(x == "", 0).otherwise(F.least(F.lit(MIN_WORDS), F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1))
    made = F.transform(F.transform(F.split(plain, _CUT), lambda x: F.trim(x)), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("u"), n_words(x).alias("n")))
    return _let(made, lambda x: F.struct(F.filter(x, lambda y: y["n"] > 0).alias("v"), F.size(x).alias("size")))


def _windows(s: Column) -> Column:
    """(h, first, last) of the windows of ``s``; the last unit of a window is the last blank one that follows it.

    A unit's window up to it is its window from another one, or a longer run from the last unit whose window ends before it.
    """
    owner = F.flatten(F.transform(s["v"], lambda x, m: F.array_repeat(m, x["n"])))  # the unit of every word
    leads = F.flatten(F.transform(s["v"], lambda x: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), x["n"] - 1))))
    # For the first word of every unit, the unit of the last of MIN_WORDS words; the last units have no window.
    ends = _let(leads, lambda lead: F.filter(F.slice(owner, MIN_WORDS, F.size(lead)), lambda _, j: F.get(lead, j)))
    made = F.struct(s["v"]["i"].alias("i"), s["v"]["u"].alias("u"), s["size"].alias("size"), ends.alias("ends"))

    def from_unit(s, a, end):
        until = F.coalesce(F.get(s["ends"], a + 1), F.size(s["u"])) - 1
        h = lambda b: F.xxhash64(F.slice(s["u"], a + 1, b - a + 1)).alias("h")
        row = lambda b: F.struct(h(b), F.get(s["i"], a).alias("first"), (F.coalesce(F.get(s["i"], b + 1), s["size"]) - 1).alias("last"))
        return F.transform(F.sequence(end, F.greatest(end, until)), row)

    return _let(made, lambda s: F.flatten(F.transform(s["ends"], lambda end, a: from_unit(s, a, end))))


def prepared(docs: DataFrame) -> DataFrame:
    """h, d (id), t (a hash of the text) and at (first and last unit) of the windows of ``docs``, a row each."""
    hashed = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")  # before the explode: after it, once a window
    w = hashed.select("d", "t", F.explode(_let(_bare_units(F.col("text")), _windows)).alias("w"))
    return w.select("w.h", "d", "t", F.expr("shiftleft(cast(w.first as bigint), 32) + w.last").alias("at"))


def joined(windows: Column) -> Column:
    """The runs (first, last), in order, that ``windows`` make up.

    Sorted by their first units, windows never end sooner than those before: least ones do not, and runs joined before do not overlap.
    """
    near = lambda r, j, x: F.get(r, j - 1)["last"] + 1 >= x["first"]
    starts = lambda r: F.filter(r, lambda x, j: (j == 0) | ~near(r, j, x))
    ends = lambda r: F.filter(r, lambda x, j: F.coalesce(F.get(r, j + 1)["first"] > x["last"] + 1, F.lit(True)))
    return _let(F.array_sort(windows), lambda r: F.zip_with(starts(r), ends(r), lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last"))))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """d, t and runs (first, last unit) that repeat an earlier document or an earlier part of the own one."""
    places = stored(prepared(docs), "line-windows")
    counts = places.groupBy("h").agg(F.count("*").alias("c"), F.min("d").alias("d0"))
    counts = stored(counts.where("c > 1"), "line-repeats")
    total = places.count()
    hot = counts.where(F.col("c") * HOT > total).select(F.col("h").alias("hot"), F.lit(True).alias("is_hot"), F.col("d0").alias("hot_d0"))
    cold = counts.where(F.col("c") * HOT <= total).select(F.col("h").alias("key"), F.lit(True).alias("is_cold"), F.col("d0").alias("cold_d0"))
    found = places.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left")  # fewer than HOT rows
    found = found.withColumn("own", F.when(F.col("is_hot"), F.xxhash64("d", "t", "at")).otherwise(F.col("h")))
    found = found.join(cold, F.col("own") == F.col("key"), "left").where("is_hot or is_cold")
    found = found.select("h", "d", "t", "at", F.when(F.col("is_hot"), F.col("hot_d0")).otherwise(F.col("cold_d0")).alias("d0"))
    found = stored(found, "line-places")
    same = F.col("d").eqNullSafe(F.col("d0"))
    # Of the first document, the first place stays.
    own = found.where(same).groupBy("h").agg(F.min(F.struct("t", "at")).alias("first"), F.count("*").alias("c")).where("c > 1").select("h", "first")
    again = found.where(same).join(own, "h").where(F.struct("t", "at") > F.col("first"))
    later = found.where(~same).select("d", "t", "at").unionAll(again.select("d", "t", "at"))
    first, last = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    blocks = later.groupBy("d", "t", F.floor(first / _BLOCK).alias("block")).agg(F.collect_set(F.struct(first.alias("first"), last.alias("last"))).alias("windows"))
    parts = blocks.groupBy("d", "t").agg(F.flatten(F.collect_list(joined(F.col("windows")))).alias("windows"))
    return parts.select("d", "t", joined(F.col("windows")).alias("runs"))


def outside(s: Column) -> Column:
    """The entries of array u that no run of r (disjoint, in order) covers."""
    last = lambda j: F.coalesce(F.get(s["r"], j - 1)["last"], F.lit(-1))
    between = F.transform(s["r"], lambda x, j: F.slice(s["u"], last(j) + 2, x["first"] - last(j) - 1))
    end = F.element_at(s["r"], -1)["last"]
    return F.concat(F.flatten(between), F.slice(s["u"], end + 2, F.size(s["u"])))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``; adds n_removed_units and n_removed_chars."""
    found = repeated_runs(docs.select("doc_id", "text")).withColumnsRenamed({"d": "found_d", "t": "found_t"})
    own = [c for c in docs.columns if c not in ("text", "n_removed_units", "n_removed_chars")]
    rows = docs.select(F.struct(*quoted(own)).alias("row"), F.col("text").alias("old"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    out = rows.join(found, F.col("d").eqNullSafe(F.col("found_d")) & (F.col("t") == F.col("found_t")), "left")
    out = out.withColumn("all", F.when(F.col("runs").isNotNull(), units(F.col("old"))))
    out = out.withColumn("kept", F.when(F.col("runs").isNotNull(), _let(F.struct(F.col("all").alias("u"), F.col("runs").alias("r")), outside)))
    out = out.withColumn("new", F.when(F.col("runs").isNull(), F.col("old")).otherwise(F.rtrim(_uncut(F.array_join("kept", "")), F.lit(" \n"))))
    return out.select(
        *[F.col("row")[c].alias(c) for c in own],
        F.col("new").alias("text"),
        F.coalesce(F.size("all") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed_units"),
        F.coalesce(F.length("old") - F.length("new"), F.lit(0)).cast("long").alias("n_removed_chars"),
    )
