"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over features of the text.  :func:`order_rules` measures on a sample how
often a rule rejects and how much text or how many words it must go over that the base counts have not paid for already,
and sorts by rejections per cost; :func:`cascade` then tests the rules in that order inside one ``CASE``, so a row stops
at its first rejection.  The order never changes the verdict, only the work done and which rule is named first; costs
are counted, not timed, so reruns agree on both.

Null or empty texts have no words and fail ``too_short``.  Very long texts are worked through by array functions in time
n log n of their words.  Repeated rows are judged alike, one result row per input row; a value equal to a rule's bound
passes; rules of equal rank keep the order given.  Columns of the input with other names pass through :func:`cascade` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Characters that count as symbols (a fixed value of the contract).
SYMBOLS = "#*$%&|<>"


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_text``, ``_words``, ``_lines`` and ``_grams`` (sorted hashes of 3-word windows).

    Each is a column of its own projection and is used more than once below, so Catalyst keeps it
    computed once a row instead of inlining it into the lambdas that read it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("_text", text).withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    w = F.col("_words")
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(w[i - 1], w[i], w[i + 1])))
    out = out.withColumn("_grams", F.coalesce(grams, F.array().cast("array<bigint>")))
    out = out.withColumn("_sorted", F.sort_array("_grams"))
    s = F.col("_sorted")
    # hashes found twice or more, once each: equal to the next in order, unlike the one before
    twice = F.filter(s, lambda x, i: (F.get(s, i + 1) == x) & ~F.coalesce(F.get(s, i - 1) == x, F.lit(False)))
    out = out.withColumn("_twice", F.when(F.size(s) > 1, twice).otherwise(F.array().cast("array<bigint>")))
    return out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))


def add_repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside a 3-word window that the text holds twice or more.

    The windows' starts are found through ``_twice``: by a scan of that list while it is short, else among
    neighbours in (hash, start) order.  In order of start p, each covers ``min(3, next p - p)`` words, the last 3.
    """
    g, d = F.col("_grams"), F.col("_twice")
    few = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_pairs", F.when(F.size("_twice") > 48, pairs))
    p = F.col("_pairs")
    many = F.sort_array(
        F.transform(F.filter(p, lambda x, k: F.coalesce(F.get(p, k + 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(p, k - 1)["x"] == x["x"], F.lit(False))), lambda x: x["i"])
    )
    at = F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.size("_twice") <= 48, few).otherwise(many)
    df = df.withColumn("_at", at)
    a = F.col("_at")
    covered = F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", covered)


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    df = add_repeat_words(text_features(df, text_col))
    n = F.size("_words").cast("long")
    df = df.withColumns({
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
    })
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """``rejects``: true where the rule turns a row away; read from the columns of :func:`base_counts` or the text.

    ``work``: characters (or as much) that testing a row goes over, beside the base counts.
    """

    name: str
    rejects: Column
    work: Column


def default_rules() -> list[Rule]:
    c, nothing = F.col, F.lit(0)
    count = lambda array, test: F.size(F.filter(array, test))
    return [
        Rule("too_short", c("n_words") < 50, nothing),
        Rule("repeats_itself", 100 * c("n_repeat_words") > 50 * c("n_words"), nothing),
        Rule("symbols", 10 * c("n_symbols") > 3 * c("n_words"), nothing),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")), nothing),
        Rule("dup_lines", (c("n_dup_lines") > 2) & (2 * c("n_dup_lines") > c("_n_lines")), nothing),
        Rule("shouting", 3 * F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")) > c("word_chars"), F.length("_text")),
        Rule("one_word", F.size(F.array_distinct("_words")) * 10 < c("n_words"), 6 * F.size("_words")),
        Rule("few_letters", 10 * count(c("_words"), lambda w: w.rlike(r"\p{L}")) < 3 * c("n_words"), 8 * F.size("_words")),
        Rule("bullets", (c("_n_lines") > 3) & (10 * count(c("_lines"), lambda x: x.rlike(r"^[ \t]*[-*•]")) > 9 * c("_n_lines")), 8 * F.size("_lines")),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = 1000, each: float = 1.0) -> list[Rule]:
    """Sort rules by rejection rate over cost, both estimated in one pass over a sample of about ``sample_rows`` rows of ``docs``.

    A rule's cost is the mean of its ``work``, and ``each`` for the test itself.
    """
    total = docs.count()
    if not total or not rules:
        return list(rules)
    counted = base_counts(docs.select(text_col).sample(fraction=min(1.0, sample_rows / total), seed=11), text_col)
    counted = counted.select(*[r.rejects.alias(f"r{k}") for k, r in enumerate(rules)], *[r.work.alias(f"w{k}") for k, r in enumerate(rules)])
    found = counted.agg(*[F.count_if(f"r{k}").alias(f"r{k}") for k in range(len(rules))], *[F.avg(f"w{k}").alias(f"w{k}") for k in range(len(rules))]).first()
    return sorted(rules, key=lambda r: -found[f"r{rules.index(r)}"] / (each + (found[f"w{rules.index(r)}"] or 0.0)))


def cascade(df: DataFrame, rules: list[Rule], name: str = "rejected_by") -> DataFrame:
    """Add the name of the first rule, in the order given, that turns the row away; null: the row is kept."""
    verdict = F
    for r in rules:
        verdict = verdict.when(r.rejects, F.lit(r.name))
    verdict = verdict.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    # a generated column: a filter on it is not pushed down, where its features would be inlined into each other's lambdas
    return df.withColumn(name, F.explode(F.array(verdict)))


def quality_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``rejected_by`` and ``kept``."""
    rules = default_rules() if rules is None else rules
    out = cascade(base_counts(docs, text_col), order_rules(docs, rules, text_col, sample_rows))
    helpers = [c for c in out.columns if c in ("_text", "_words", "_grams", "_sorted", "_twice", "_pairs", "_at", "_lines", "_n_lines")]
    out = out.withColumn("kept", F.col("rejected_by").isNull() & ~F.col("base_failed")).drop(*helpers)
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
    given = [c for c in docs.columns if c not in made]
    return out.select(*given, F.explode(F.array(F.struct(*made))).alias("_made")).select(*given, "_made.*")
