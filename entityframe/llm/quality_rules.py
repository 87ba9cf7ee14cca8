"""Quality rules: a table of thresholds compiled into one Spark projection (no user functions).

Null texts count as empty. Every row gets a row back, repeated rows included; columns of the input other than the id and
the text are not read, so their names cannot clash with the measures. A null id stays null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityframe.llm import text as T


@dataclass(frozen=True)
class Threshold:
    """Rejects a document whose measure lies outside [least, most]; an open side is None."""

    measure: str
    least: float | None = None
    most: float | None = None

    def broken(self) -> Column:
        value, parts = F.col(self.measure), []
        if self.least is not None:
            parts.append(value < F.lit(self.least))
        if self.most is not None:
            parts.append(value > F.lit(self.most))
        return reduce(lambda a, b: a | b, parts, F.lit(False))


REPEAT_WIDTH = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# The verdict beyond the base rules. Each bound stands well clear of running prose in any of the four languages.
RULES: tuple[Threshold, ...] = (
    Threshold("mean_word_chars", 2.0, 20.0),
    Threshold("longest_word_chars", most=1000),
    Threshold("symbol_ratio", most=0.2),
    Threshold("mark_ratio", most=0.5),
    Threshold("stop_word_ratio", least=0.02),
    Threshold("dup_line_ratio", most=0.5),
)


def measures(text: Column) -> dict[str, Column]:
    """The counts every rule is made of."""
    return {
        "__words": T.words(text),
        "__lines": T.lines_with_words(text),
        "n_symbols": T.count_of(text, T.SYMBOLS),
        "n_marks": T.count_of(text, r"[#*$%&|<>!?=+~^{}\[\]\\]"),
    }


def stop_words(words: Column) -> Column:
    """How many words are stop words of any of the languages."""
    known = sorted({w for group in T.STOP_WORDS.values() for w in group})
    return T.long_size(F.filter(words, lambda w: F.lower(w).isin(known)))


def judge(docs: DataFrame, rules: tuple[Threshold, ...] = RULES, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), lang: str = "lang") -> DataFrame:
    """Per document: the base measures, the ratios the rules read, ``base_failed`` and ``kept``.

    ``base_failed``: under 20 words, or over 30 % of the words lie in an 8-word window that the text holds twice or more.
    ``kept`` is false if that holds or a threshold is broken; the one on stop words only counts for documents in a language
    with a list of them, or without a language. Columns in ``carry`` come along in a struct ``row``.
    """
    t = F.col("__text")
    row = [F.struct(*carry).alias("row")] if carry else []
    kept = ["doc_id", "__listed", *["row" for _ in row]]
    known = F.coalesce(F.lower(F.col(lang)).isin(sorted(T.STOP_WORDS)), F.lit(True))
    counted = docs.select(F.col(doc_id).alias("doc_id"), known.alias("__listed"), F.col(text).alias("__text"), *row).select(*kept, *[c.alias(n) for n, c in measures(t).items()])
    based = counted.select(
        *kept,
        T.long_size(F.col("__words")).alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        T.repeats(F.col("__lines")).alias("n_dup_lines"),
        T.covered_by_repeats(F.col("__words"), REPEAT_WIDTH).alias("n_repeat_words"),
        "n_marks",
        stop_words(F.col("__words")).alias("n_stops"),
        T.long_size(F.col("__lines")).alias("n_lines"),
        F.coalesce(F.array_max(F.transform("__words", lambda w: F.length(w))), F.lit(0)).cast("long").alias("longest_word_chars"),
    )
    n = F.col("n_words")
    shares = based.withColumns(
        {
            "mean_word_chars": T.ratio(F.col("word_chars"), n),
            "symbol_ratio": T.ratio(F.col("n_symbols"), n),
            "mark_ratio": T.ratio(F.col("n_marks"), n),
            "stop_word_ratio": T.ratio(F.col("n_stops"), n),
            "dup_line_ratio": T.ratio(F.col("n_dup_lines"), F.col("n_lines")),
            "base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        }
    )
    counts = lambda r: r.broken() & F.col("__listed") if r.measure == "stop_word_ratio" else r.broken()
    broken = reduce(lambda a, b: a | b, [counts(r) for r in rules], F.lit(False))
    return shares.withColumn("kept", ~F.col("base_failed") & ~broken).drop("__listed")
