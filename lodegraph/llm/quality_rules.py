"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A rule rejects a document when a ratio of its words exceeds a cutoff.  A cutoff is used
only if labelled holdouts prove it harmless: among the ``n`` documents of a stratum labelled
good, of which the rule would reject ``k``, the exact binomial (Clopper-Pearson) upper bound
of the false-rejection rate must stay at or below ``alpha`` - that is, ``P(Bin(n, alpha) <= k)``
must be at most the error level of the test.  ``delta``, the chance that any cutoff in use
breaks its promise, is divided among rules and strata (Bonferroni), ``alpha`` among the rules
(so that their union keeps it), and within one rule the cutoffs are tested from the laxest
to the strictest and the walk stops at the first failure (fixed sequence), which needs no
further correction.  A stratum without enough labelled documents gets no cutoff, and its
documents face the base rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Ratio of each rule in thousandths, as (name, numerator, denominator), and its cutoffs from lax to strict:
#: a document is rejected whose ratio is above the cutoff.
RULES = [
    ("symbols", "n_symbols", "word_chars", [400, 300, 200, 150, 100, 70, 50, 30]),
    ("marks", "n_marks", "word_chars", [400, 300, 250, 200, 160, 130, 100]),
    ("capitals", "n_capitals", "word_chars", [900, 800, 700, 600, 500, 400, 300, 200]),
    ("dup_lines", "n_dup_lines", "n_lines", [900, 800, 700, 600, 500, 400, 300]),
    ("repeats", "n_repeat_words", "n_words", [190, 170, 150, 130, 110, 90]),
    ("adjacent", "n_adjacent", "n_words", [800, 600, 500, 400, 300, 250, 200, 150]),
]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_marks", "n_capitals", "n_lines", "n_adjacent")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _covered(hashes: Column) -> Column:
    """Words that lie in a window found twice or more; ``hashes`` has each window's hash in order."""

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(z: Column) -> Column:
            def twice(_, j):
                return (F.get(z, j - 1)["h"] == z[j]["h"]) | (F.get(z, j + 1)["h"] == z[j]["h"])

            # get() is null outside the array, and "null or true" is true, "null or false" null: not kept
            return F.array_sort(F.transform(F.filter(z, twice), lambda x: x["i"]))

        def union(p: Column) -> Column:
            gain = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gain, F.lit(0).cast("long"), lambda s, x: s + x)

        return C.let(C.let(pairs, positions), union)

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), C.let(hashes, of)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The counts of the rules beside the columns ``keep``; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_text"), words_of(text).alias("_words"))
    df = df.withColumn("_n", F.size("_words"))
    windows = F.when(F.col("_n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("_n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    df = df.withColumn("_windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(C.NO_WHITE))
    df = df.withColumn("_lines", lines)
    adjacent = F.aggregate(F.zip_with("_words", F.slice("_words", 2, F.greatest(F.col("_n"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_windows")).alias("n_repeat_words"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_marks"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        adjacent.alias("n_adjacent"),
    )


def ratio(rule: tuple) -> Column:
    """Whole thousandths; a document without the denominator has ratio 0."""
    name, over, under, _ = rule
    return F.when(F.col(under) > 0, F.expr(f"(1000 * {over}) div {under}")).otherwise(F.lit(0)).cast("long")


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)``; 1 where ``k > n * p``, as such a test cannot pass."""
    odds = p / (1 - p)
    zero = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), zero, lambda a, i: F.when(i <= k, step(a, i)).otherwise(a), lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def cutoffs(counts: DataFrame, labels: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """``(stratum, rule, cutoff)``: the strictest proven cutoff of each rule in each stratum, where there is one."""
    good = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = counts.join(good, "doc_id", "left_semi")
    wanted = [F.sum((ratio(r) > c).cast("long")).alias(f"{r[0]}_{c}") for r in RULES for c in r[3]]
    table = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *wanted)
    tests = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(i).alias("step"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{r[0]}_{c}").alias("k")) for r in RULES for i, c in enumerate(r[3])])
    table = table.withColumn("_strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    tried = table.select("stratum", "n", "_strata", F.inline(tests))
    level = F.lit(delta) / (len(RULES) * F.col("_strata"))
    tried = tried.withColumn("_ok", (binomial_cdf(F.col("k"), F.col("n"), alpha / len(RULES)) <= level).cast("int"))
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    passed = tried.withColumn("_all", F.min("_ok").over(walk)).filter("_all = 1")
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.06, delta: float = 0.05, max_words: int = 20, min_words: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict for every row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``
    and ``failed_rules`` (names, an empty list for none).  ``base_failed``: fewer than
    ``min_words`` words, or more than ``max_words`` per cent of them repeated.  A null text has no
    words and fails; a null or unlabelled stratum faces the base rules alone; repeated rows
    are judged alike.  Labels of one id that conflict count as the lower one.  The columns
    ``carry`` are passed on; other columns of ``docs`` are not read.  The cutoffs are one row for each stratum and rule.
    """
    keep = list(dict.fromkeys(["doc_id", stratum, *carry]))
    counts = C.settle(measured(docs, keep), "rule-counts")
    proven = cutoffs(counts, labels, stratum, alpha, delta)
    limits = proven.groupBy("stratum").pivot("rule", [r[0] for r in RULES]).agg(F.first("cutoff"))
    limits = limits.select(F.col("stratum").alias("_stratum"), *[F.col(r[0]).alias(f"_max_{r[0]}") for r in RULES])
    limits = C.settle(limits, "rule-cutoffs")
    df = counts.join(limits, F.col(stratum) == F.col("_stratum"), "left")
    failed = F.filter(F.array(*[F.when(ratio(r) > F.col(f"_max_{r[0]}"), F.lit(r[0])) for r in RULES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_words * F.col("n_words"))
    df = df.withColumn("failed_rules", failed).withColumn("base_failed", base)
    return df.select("doc_id", *carry, *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
