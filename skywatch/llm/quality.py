"""Operator 6: quality rules, a threshold table compiled into one projection of ratios.

``RULES`` names each ratio with its lowest and highest accepted value. ``with_quality`` measures a
text once and evaluates all rules in one projection, with Spark functions only: no join, no shuffle,
no user function. A null or empty text has no words, fails ``n_words`` and is not kept. Repeated
rows are judged alike; other columns pass through, and result columns take a spare name where the
input has one of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywatch.llm.columns import SPACES, or_empty, split_words
from skywatch.llm.common import spare_name

SYMBOLS = r"[#*$%&|<>]"
SPAN = 5

# Frequent function words, in each language's usual order of frequency.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se "
    "de la que el en y a los se del las un por con no una su para es al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= top / bottom <= high`` for texts of at least ``from_words`` words."""

    name: str
    top: str
    bottom: str | None
    low: float | None
    high: float | None
    from_words: int = 1


#: The threshold table. Ratios are per word or per line with a word.
RULES = (
    Rule("too_few_words", "n_words", None, 10, None, 0),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.2),
    Rule("word_length", "word_chars", "n_words", 1.5, 25.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", None, 1, None, 40),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
)


def _twice(sorted_: str) -> Column:
    """Places of windows found twice or more: equal neighbours in the (hash, place) order."""
    x = F.col(sorted_)
    marked = F.transform(
        x, lambda w, k: F.when(F.get(x, k - 1)["h"].eqNullSafe(w["h"]) | F.get(x, k + 1)["h"].eqNullSafe(w["h"]), w["i"])
    )
    return F.array_sort(F.array_compact(marked))


def _union_size(places: str) -> Column:
    """Words in the union of the windows at these places, in order."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda a, p: F.struct(
            (a["n"] + SPAN - F.greatest(F.lit(0), a["end"] - p)).cast("long").alias("n"), (p + SPAN).alias("end")
        ),
        lambda a: a["n"],
    )


def measures(text: Column) -> list[dict[str, Column]]:
    """Columns in layers: each layer uses the names of those before it."""
    c = F.col
    return [
        {"_words": split_words(or_empty(text), SPACES), "_lines": F.filter(F.split(or_empty(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))},
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(or_empty(text), F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
            "n_stop_words": F.size(F.array_intersect("_words", F.array(*map(F.lit, STOP_WORDS)))).cast("long"),
            "_windows": F.when(
                F.size("_words") >= SPAN,
                F.transform(F.sequence(F.lit(1), F.size("_words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("_words", i, SPAN))),
            ).otherwise(F.array().cast("array<bigint>")),
        },
        {"_repeats": F.size(F.array_distinct("_windows")) < F.size("_windows")},
        # A column of its own for each step: inside a lambda an expression is evaluated for each element.
        {"_sorted": F.when(c("_repeats"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))},
        {"_places": F.when(c("_repeats"), _twice("_sorted"))},
        {"n_repeat_words": F.when(c("_repeats"), _union_size("_places")).otherwise(F.lit(0).cast("long"))},
    ]


def _failed(rule: Rule) -> Column:
    top = F.col(rule.top)
    if rule.bottom is not None:
        top = top / F.greatest(F.col(rule.bottom), F.lit(1))
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (top < rule.low)
    if rule.high is not None:
        bad = bad | (top > rule.high)
    return (F.col("n_words") >= rule.from_words) & bad


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_stop_words", "n_repeat_words"
)
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept", "failed_rules")


def with_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``kept`` and ``failed_rules`` (names, comma-joined).

    Windows of five words are compared by 64-bit hashes within one text.
    """
    inner = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    for layer in measures(F.col("_text")):
        inner = inner.withColumns(layer)
    # A generator of one row keeps later filters above the measures: pushed below, a filter would
    # repeat their expressions, inside lambdas even for each element.
    inner = inner.select("_row", F.inline(F.array(F.struct(*MEASURES))))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(_failed(r), F.lit(r.name)) for r in rules)))
    inner = inner.withColumns({"base_failed": base, "_failed": failed})
    inner = inner.withColumns(
        {"kept": ~F.col("base_failed") & (F.size("_failed") == 0), "failed_rules": F.array_join("_failed", ",")}
    )
    own = [F.col("_row")[f].alias(f) for f in docs.columns]
    return inner.select(*own, *(F.col(r).alias(spare_name(r, docs.columns)) for r in RESULTS))
