"""Operator 3: quality rules as one Spark projection.

``BOUNDS`` lists, for each measured ratio, the range that a kept document stays
in.  ``quality`` compiles the measures and the table into column expressions; no
user function runs.  Work and memory are bounded by the single text: no pattern
tries a run of white space from more than one place, and 3-word windows are sorted
as packed longs (window hash above, position below), n log n in the words; a text of more than ``LONG`` words leaves the hash
too few bits of one long, so its windows are sorted by a whole hash first and
the packed long of a second hash after it.

Counts are exact: windows with equal hashes are compared word by word, and a text
in which two different windows share a hash sorts the windows themselves.

Null text has no words: all counts are 0 and the base rule fails it.  Columns of
``documents`` that bear the name of a measure are replaced by it; no other changes,
whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read

# Frequent function words of the four languages.
STOP_WORDS = ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "der", "die", "und", "den", "von", "zu", "das", "le", "la", "les", "de", "et", "un", "que", "en", "el", "los", "y", "se", "del", "por", "des", "du", "ein", "con", "be", "with", "as", "on", "was")
#: measure: (least, most); None is no bound.
BOUNDS: dict[str, tuple[float | None, float | None]] = {
    "n_words": (50, 100_000),
    "mean_word_length": (2, 12),
    "symbol_word_ratio": (None, 0.1),
    "stop_word_count": (2, None),
    "bullet_line_ratio": (None, 0.9),
    "ellipsis_line_ratio": (None, 0.3),
    "dup_line_ratio": (None, 0.3),
    "repeat_word_ratio": (None, 0.5),
}
#: From so many words on a window's hash has more than 64 bits (at 5 million words 105).
LONG = 20_000
SPACE = " \t\n\x0b\f\r"


def _three(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def _mask(n: Column) -> Column:
    """Mask of a hash whose low bits hold a position below ``n``."""
    return F.call_function("shiftleft", F.lit(-1).cast("long"), F.ceil(F.log2(n + 1)).cast("int"))


def _starts(n: Column) -> Column:
    return F.sequence(F.lit(0), (n - 3).cast("int"))


def _states(windows: Column, words: Column, key, place) -> Column:
    """Of sorted windows: 0 where the hash differs from the one before, 1 where the window is the same, 2 where only the hash is."""

    def state(x: Column, i: Column) -> Column:
        before = F.get(windows, i - 1)
        p, q = place(x), place(before)
        equal = (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))
        return F.when((i == 0) | (key(x) != key(before)), 0).when(equal, 1).otherwise(2)

    return F.transform(windows, state)


def _places(windows: Column, states: Column, place) -> Column:
    """Positions of windows that stand beside an equal one; null where hashes mislead."""
    hit = F.filter(windows, lambda x, i: (F.get(states, i) == 1) | F.coalesce(F.get(states, i + 1) == 1, F.lit(False)))
    return F.when(~F.array_contains(states, 2), F.transform(hit, place))


def _with_repeats(df: DataFrame, own: dict[str, str]) -> DataFrame:
    """Column ``at``: sorted positions of the 3-word windows of ``words`` that occur more than once; ``own`` has the names of the columns."""
    h, p, s, at = (own[c] for c in ("h", "p", "s", "at"))
    n, words, keep = F.col("n_words"), F.col(own["words"]), F.col(own["keep"])
    df = df.withColumn(own["keep"], _mask(n)).withColumn(h, F.when(n <= LONG, F.transform(words, lambda w: F.xxhash64(w))))
    low = lambda x: x.bitwiseAND(F.bitwise_not(keep)).cast("int")
    packed = F.transform(_starts(n), lambda i: F.xxhash64(*_three(F.col(h), i)).bitwiseAND(keep).bitwiseOR(i.cast("long")))
    df = df.withColumn(p, F.when((n > 3) & (n <= LONG), F.sort_array(packed)))
    df = df.withColumn(s, _states(F.col(p), words, lambda x: x.bitwiseAND(keep), low))
    df = df.withColumn(at, _places(F.col(p), F.col(s), low))
    two = F.transform(_starts(n), lambda i: F.struct(F.xxhash64(*_three(words, i)).alias("h"), F.xxhash64(F.lit("second"), *_three(words, i)).bitwiseAND(keep).bitwiseOR(i.cast("long")).alias("p")))
    df = df.withColumn(p, F.when(n > LONG, F.sort_array(two)))
    df = df.withColumn(s, _states(F.col(p), words, lambda x: F.struct(x["h"], x["p"].bitwiseAND(keep)), lambda x: low(x["p"])))
    df = df.withColumn(at, F.coalesce(at, _places(F.col(p), F.col(s), lambda x: low(x["p"]))))
    # words hold no line feed, so joined words are equal only if the words are
    whole = F.transform(_starts(n), lambda i: F.struct(F.concat_ws("\n", *_three(words, i)).alias("w"), i.alias("p")))
    df = df.withColumn(p, F.when(F.col(at).isNull() & (n > 3), F.sort_array(whole)))
    df = df.withColumn(s, _states(F.col(p), words, lambda x: x["w"], lambda x: x["p"]))
    return df.withColumn(at, F.sort_array(F.coalesce(at, _places(F.col(p), F.col(s), lambda x: x["p"]))))


def quality(documents: DataFrame, bounds: dict[str, tuple[float | None, float | None]] = BOUNDS) -> DataFrame:
    """``documents`` with the measures, ``base_failed``, ``failed`` (names of broken bounds) and ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {c: fresh(documents, f"_{c}") for c in ("words", "lines", "h", "p", "s", "keep", "at")}
    words, rows, at = own["words"], own["lines"], own["at"]
    df = documents.withColumn(words, F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn(rows, F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumn("n_lines", F.size(rows).cast("long"))
    df = df.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct(rows)))
    df = _with_repeats(df, own)
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    lines = lambda pattern: F.size(F.filter(rows, lambda x: x.rlike(pattern)))
    measures = {
        "n_words": F.col("n_words"),
        "mean_word_length": share(F.col("word_chars"), F.col("n_words")),
        "symbol_word_ratio": share(F.col("n_symbols"), F.col("n_words")),
        "stop_word_count": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "bullet_line_ratio": share(lines(rf"^[{SPACE}]*[-*•][{SPACE}]"), F.col("n_lines")),
        "ellipsis_line_ratio": share(lines(rf"(\.\.\.|…)[{SPACE}]*\z"), F.col("n_lines")),
        "dup_line_ratio": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_word_ratio": share(F.col("n_repeat_words"), F.col("n_words")),
    }
    for name, value in measures.items():
        if name != "n_words" and name in bounds:
            df = df.withColumn(name, value.cast("double"))
    broken = [F.when((F.col(name) < low if low is not None else F.lit(False)) | (F.col(name) > high if high is not None else F.lit(False)), F.lit(name)) for name, (low, high) in bounds.items()]
    df = df.withColumn("failed", F.array_compact(F.array(*broken)))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return df.drop(*own.values())


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))
