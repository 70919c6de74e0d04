"""Line-first quality rules.

Each line is judged alone, by punctuation, navigation and boilerplate rules; lines that fail are taken out, and a
document that loses too much of its text, or fails a rule on the whole of it, is rejected. Everything is a DataFrame
expression within a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
_SPACE = "[\\x20\\x09-\\x0D]+"
# Lines that begin like this, in lower case, are notices rather than text.
BOILERPLATE = "^(licensed under|released under|this work is licensed|copyright|all rights reserved|cookie|we use cookies|terms of (use|service)|privacy policy|subscribe|sign up|log in|share this|click here)"


def words_of(text: Column) -> Column:
    """The text's words as an array; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def repeated_starts(words: Column) -> Column:
    """Starts, ascending, of the 3-word windows that occur twice or more among ``words``.

    Windows are compared by a hash of 64 bits over their three words.
    """
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    return F.coalesce(windows, F.array().cast("array<struct<h:long,i:int>>"))


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __words, __lines, __starts and the measures that rules on whole texts use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__words", words_of(F.col(text_col))).withColumn("__lines", F.split(text, "\n"))
    rows = rows.withColumn("__windows", F.sort_array(repeated_starts(F.col("__words"))))
    w = F.col("__windows")
    same = lambda x, i, d: (F.get(w, i + d)["h"] == x["h"])
    twice = F.filter(w, lambda x, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False)))
    rows = rows.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__windows")
    s = F.col("__starts")
    covered = F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    full = F.filter("__lines", lambda x: x.rlike(WORD))
    return rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, _SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": covered,
    }).drop("__starts")


def line_fails(line: Column) -> Column:
    """Does a line fail a rule; lines without a word fail none.

    Punctuation: over a third as many symbols, or pairs of exclamation or question marks, as words. Navigation: three
    or more separators between at most two words each. Boilerplate: a notice's beginning.
    """
    n = F.regexp_count(line, F.lit(WORD))
    symbols = F.regexp_count(line, F.lit("[#*$%&<>]+|[!?]{2,}"))
    separators = F.regexp_count(line, F.lit("\\s[|>»·•/]\\s"))
    return (n > 0) & ((symbols * 3 > n) | ((separators >= 3) & (n <= separators * 3 + 3)) | F.lower(F.trim(line)).rlike(BOILERPLATE))


def line_first(docs: DataFrame, most_lost: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, ``clean_text`` (its lines that pass), ``n_lost`` (characters of words in lines that
    failed), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in 3-word windows found twice or more.
    ``kept``: not base_failed, at most ``most_lost`` of the words' characters lost, and fewer than 0.3 symbols for each word.

    Null and empty texts have no words, so they are base_failed. Repeated rows are judged alike. Columns of the names
    added are replaced; all others stay.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "n_lost", "base_failed", "kept"]
    rows = with_measures(docs.drop(*(c for c in own if c != text_col)), text_col)
    rows = rows.withColumn("__good", F.filter("__lines", lambda x: ~line_fails(x)))
    rows = rows.withColumn("clean_text", F.array_join("__good", "\n"))
    left = F.char_length(F.regexp_replace("clean_text", _SPACE, "")).cast("long")
    rows = rows.withColumn("n_lost", F.col("word_chars") - left)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    kept = ~F.col("base_failed") & (F.col("n_lost") <= F.col("word_chars") * most_lost) & (F.col("n_symbols") * 10 < F.col("n_words") * 3)
    return rows.withColumn("kept", kept).drop("__words", "__lines", "__good")
