"""Operator 3, quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_CHAR, let, words_of

OTHERS = "[^#*$%&|<>]+"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "was", "for", "by",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "dans",
    "der", "die", "das", "und", "zu", "den", "mit", "nicht", "von", "ist",
    "el", "los", "las", "y", "por", "con", "para", "se", "una",
)
STOP_WORDS += tuple(w.capitalize() for w in STOP_WORDS)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A ratio that must lie within bounds in texts of ``from_words`` words: ``numerator / denominator``, names of measures."""

    name: str
    numerator: str
    denominator: str | None = None
    least: float | None = None
    most: float | None = None
    from_words: int = 0

    def broken(self) -> Column:
        value = F.col(self.numerator).cast("double")
        if self.denominator:
            value = value / F.greatest(F.col(self.denominator), F.lit(1))
        bad = F.lit(False)
        if self.least is not None:
            bad = bad | (value < self.least)
        if self.most is not None:
            bad = bad | (value > self.most)
        return bad & (F.col("n_words") >= self.from_words)


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbol_ratio", "n_symbols", "n_words", most=0.25),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=0.02, from_words=80),
    Rule("line_ratio", "n_dup_lines", "n_lines", most=0.5),
)


def _repeated(words: Column) -> Column:
    """Words inside windows of five words found twice or more; windows are compared by 64-bit hash."""
    size = F.size(words)
    hashes = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW)))), 1, size - WINDOW + 1
    )

    def starts(sorted_grams: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            same = (F.get(sorted_grams, k - 1)["h"] == x["h"]) | (F.get(sorted_grams, k + 1)["h"] == x["h"])
            return F.when(same, x["i"])

        return F.sort_array(F.filter(F.transform(sorted_grams, one), lambda i: i.isNotNull()))

    def covered(h: Column) -> Column:
        grams = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        total = F.aggregate(
            let(grams, starts),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(total)

    return F.when(size < WINDOW, 0).otherwise(let(hashes, covered))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of every whole text as columns beside the given ones (which they replace where names clash).

    Null and empty texts count as no words: all measures are 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(
        F.split(body, "\n"), lambda line: F.rlike(line, F.lit(WORD_CHAR))
    )
    own = [c for c in docs.columns if c not in MEASURES]
    words = let(words_of(body), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated(w).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    ))
    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    symbols = F.length(F.regexp_replace(body, OTHERS, "")).cast("long")
    # one row per row: a filter on the verdict is not pushed below it, which would repeat the measures for every rule
    once = F.array(F.struct(words.alias("_w"), by_line.alias("_l"), symbols.alias("n_symbols")))
    counts = docs.select(*own, F.inline_outer(once))
    return counts.select(*own, *(F.col(source).alias(name) for name, source in MEASURES.items()))


MEASURES = {
    "n_words": "_w.n_words", "word_chars": "_w.word_chars", "n_symbols": "n_symbols",
    "n_stop_words": "_w.n_stop_words", "n_lines": "_l.n_lines", "n_dup_lines": "_l.n_dup_lines",
    "n_repeat_words": "_w.n_repeat_words",
}


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed``, the names of broken rules and ``kept`` for each row.

    Rows are judged one by one: repeated rows get the same verdict each, an empty table gives an
    empty one, null or empty text fails the base rule. No shuffle, no user function.
    """
    measured = measure(docs, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    broken = F.filter(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    judged = measured.withColumns({"base_failed": base, "broken_rules": broken})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    columns = docs.columns
    extra = {c: f"_given_{c}" for c in columns if c in {*MEASURES, "base_failed", "broken_rules", "kept", "_w", "_l"}}
    judged = judge(docs.withColumnsRenamed(extra), extra.get(text, text), rules)
    return judged.filter("kept").select(*(F.col(extra.get(c, c)).alias(c) for c in columns))
