"""Quality rules with risk-controlled cutoffs.

Each rule is a statistic of a text that grows with junk, and a fixed ladder of cutoffs. The ladders are merged into one
stated sequence of configurations: step by step the rules, in their order, take their next stricter cutoff, so every
configuration rejects what the one before rejects, and more. A document's `first` is the earliest configuration that
rejects it.

Documents whose quality is labelled are the holdout. In each stratum (language) configurations are tested in sequence,
with the exact binomial distribution: is it refuted, at level `delta / (strata + 1)`, that the configuration rejects
more than `risk` of the good documents? False rejections only grow along the sequence, so testing stops at the first
configuration that is not refuted and needs no further factor for the number of rules and cutoffs; strata and the pooled
one share `delta` (Bonferroni). With probability 1 - delta no stratum loses more than `risk` of its good documents to all
rules together. Of the admissible configurations the one of best gain (bad documents rejected less `COST` times the good
ones) is used, the laxest of equals, none if none gains.

With n good documents and none rejected the least risk that can be refuted is 1 - level ** (1 / n) (`attainable`): 2 % at
level 0.01 takes 228. A stratum with fewer uses the configuration of the pooled stratum of all languages, whose promise is
about all good documents together; if that is too small as well, the rules stay off.

Only DataFrame functions are used. Statistics are computed once for each row and staged; the counts are partial sums on
(stratum, first), so a hot stratum costs nothing.

Defined results: null and empty texts have no words and fail the base rules; a null stratum is a stratum of its own; of
repeated labels the larger counts; without labels only the base rules hold; a stratum without labels is a small one;
repeated rows each get their verdict; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, small, stage, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: Rule: statistic over the staged columns, and its cutoffs from lax to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_pct": ("100.0D * n_symbols / word_chars", (40.0, 30.0, 20.0, 15.0, 10.0, 5.0)),
    "dup_line_pct": ("100.0D * n_dup_lines / n_lines", (80.0, 60.0, 40.0, 30.0, 20.0, 10.0)),
    "repeat_pct": ("100.0D * n_repeat_words / n_words", (45.0, 40.0, 30.0, 20.0, 10.0, 5.0)),
    "word_length": ("CAST(word_chars AS DOUBLE) / n_words", (20.0, 16.0, 14.0, 12.0, 10.0, 9.0)),
    "bang_pct": ("100.0D * n_bangs / n_words", (150.0, 100.0, 60.0, 30.0, 15.0, 8.0)),
    "sameness_pct": ("100.0D - 100.0D * n_distinct / n_words", (98.0, 95.0, 90.0, 85.0, 80.0, 75.0)),
}
RISK, DELTA = 0.02, 0.05
#: Good documents that one rejected bad document may cost.
COST = 5


def repeated_words(w: Column) -> Column:
    """Words within 3-word windows that occur at least twice in w."""

    def covered(spots: Column) -> Column:
        return F.aggregate(
            F.transform(spots, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(spots, i + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x
        )

    def spots(placed: Column) -> Column:
        same = lambda e, i: (F.get(placed, i - 1)["h"] == e["h"]) | (F.get(placed, i + 1)["h"] == e["h"])
        marks = F.transform(placed, lambda e, i: F.when(F.coalesce(same(e, i), F.lit(False)), e["i"]))
        return F.array_sort(F.filter(marks, lambda x: x.isNotNull()))

    def windows(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, lambda p: let(spots(p), covered)))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), count)).cast("long")


def _occurrences(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), chars, text))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, stratum and the counts that the rules use, one row a document."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), t.alias("text"), words(t).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    base = base.select("doc_id", "stratum", "text", "w", lines.alias("lines"))
    return base.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _occurrences(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _occurrences(F.col("text"), "!").cast("long").alias("n_bangs"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 7."""
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    rise = reduce(lambda a, b: a * b, (x + i for i in range(7)))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - F.ln(rise)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), exact to double precision; 1 where k >= n * p, which no test needs.

    Terms fall from k downwards; those beyond 40 standard deviations are under the smallest double.
    """
    n, k = n.cast("double"), k.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    low = F.greatest(F.lit(1.0), k - (40 * F.sqrt(n * p) + 50))
    steps = F.when(k >= 1, F.sequence(k.cast("long"), low.cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def fold(a: Column, j: Column) -> Column:
        term = a["term"] * j * (1 - p) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * F.aggregate(steps, start, fold)["sum"])


def _ratio(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.expr(f"{over} / nullif({under}, 0)")


def rejecting_step(rule: str) -> Column:
    """The first step of a rule's ladder that rejects the row; null if none does."""
    value = _ratio(rule)
    return F.coalesce(*(F.when(value > c, F.lit(i)) for i, c in enumerate(RULES[rule][1])))


def first_rejecting() -> Column:
    """The first configuration that rejects the row, null if none: step * rules + place of the rule."""
    return F.least(*(rejecting_step(r) * len(RULES) + k for k, r in enumerate(RULES)))


def attainable(n: int, level: float) -> float:
    """The least risk that n good documents can refute at a level, when none is rejected."""
    return 1 - level ** (1 / n) if n else 1.0


def calibrate(stats: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row a stratum and one for all (pooled true): n good documents, level, attainable risk and the last configuration that holds (null: none).

    stats: columns of `statistics` and `first`; labels: key, quality 0/1.
    """
    known = labels.where("quality IS NOT NULL").groupBy(F.col(key).alias("label_key")).agg(F.max("quality").alias("quality"))
    held = stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("label_key"))
    cells = held.groupBy("stratum", "first").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    cells = stage(cells, "rules-counts")  # strata times configurations
    every = cells.groupBy("first").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    cells = cells.withColumn("pooled", F.lit(False)).unionByName(every.withColumns({"pooled": F.lit(True), "stratum": F.lit(None).cast(stats.schema["stratum"].dataType)}))
    sizes = cells.groupBy("pooled", "stratum").agg(F.sum("good").alias("n"))
    sizes = sizes.withColumn("level", F.lit(delta) / F.count(F.lit(1)).over(Window.partitionBy()))  # one row a stratum
    sizes = sizes.withColumn("attainable", F.when(F.col("n") > 0, 1 - F.pow("level", 1 / F.col("n"))).otherwise(1.0))
    so_far = Window.partitionBy("pooled", "stratum").orderBy("first")
    steps = cells.where("first IS NOT NULL").withColumns({"good": F.sum("good").over(so_far), "bad": F.sum("bad").over(so_far)})
    same = [F.col("pooled") == F.col("p"), F.col("stratum").eqNullSafe(F.col("s"))]
    tested = steps.join(sizes.select(F.col("pooled").alias("p"), F.col("stratum").alias("s"), "n", "level"), same[0] & same[1]).drop("p", "s")
    gain = F.col("bad") - COST * F.col("good")
    safe = tested.withColumn("gain", gain).where("gain > 0").where(binomial_tail(F.col("n"), F.col("good"), risk) <= F.col("level"))
    best = safe.groupBy(F.col("pooled").alias("p"), F.col("stratum").alias("s")).agg(F.max_by("first", F.struct("gain", -F.col("first"))).alias("last"))
    return sizes.join(best, same[0] & same[1], "left").select("pooled", "stratum", "n", "level", "attainable", "last")


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = RISK) -> DataFrame:
    """Counts, base_failed, the rules that reject, and kept, for every row of docs."""
    stats = stage(statistics(docs, key, "text", stratum).withColumn("first", first_rejecting()), "rules-statistics")
    found = stage(calibrate(stats, labels, key, risk), "rules-configurations")
    large = F.pow(F.lit(1 - risk), "n") <= F.col("level")
    own = small(found.where("NOT pooled").select(F.col("stratum").alias("s"), large.alias("large"), F.col("last").alias("own")))
    every = found.where("pooled").agg(F.max("last")).first()[0]  # one number
    judged = stats.join(own, F.col("stratum").eqNullSafe(F.col("s")), "left")
    last = F.when(F.coalesce("large", F.lit(False)), F.col("own")).otherwise(F.lit(every).cast("int"))
    judged = judged.withColumn("last", last).withColumn("base_failed", base_failed())
    hit = [F.when(rejecting_step(r) * len(RULES) + k <= F.col("last"), F.lit(r)) for k, r in enumerate(RULES)]
    judged = judged.withColumn("rejected_by", F.filter(F.array(*hit), lambda x: x.isNotNull()))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
