"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Statistics of whole texts feed two kinds of rules. The base rules are fixed: too few words, or too many words in repeated windows. The others
compare a statistic with a cutoff that is *learnt from labelled documents under a guarantee*: in each stratum (a language), for each
statistic, a fixed grid of cutoffs is tested from the most lenient to the strictest. A cutoff passes while the exact binomial tail
P(Bin(n, alpha / rules) <= k) is at most delta / (strata * rules), where n good labelled documents were seen and k of them would be
rejected; the first that fails ends the sequence (fixed-sequence testing, so the grid's length costs nothing), and Bonferroni's division
covers strata and rules. With probability 1 - delta, then, in every stratum at most the share alpha of good documents is rejected by
these rules.  Where a stratum has too few good labels for all rules (even if none of them were rejected), its alpha and delta are spent on the first
of them only, as many as its number of labels can prove; the number of labels alone decides that, so the guarantee holds. A stratum with too few
for one rule keeps all that the base rules keep.

Defined results: a null text has no words and fails the base; a null stratum is a stratum; a document with several labels is good if all
its labels are, and so counts once, of several rows of its id that with the greatest statistics; labels of unknown documents or of null quality play no part; repeated rows are judged alike; without any
labels, or over an empty table, the base rules alone hold; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm import common

ALPHA, DELTA = 0.05, 0.05
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
#: For each rule its cutoffs, from lenient to strict: documents whose statistic is above the cutoff are rejected.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "duplicate_lines_share": (0.9, 0.8, 0.7, 0.6, 0.5),
    "word_length": (30.0, 26.0, 22.0, 18.0, 16.0, 14.0),
}
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"
#: How many strata are broadcast; beyond that the thresholds are joined by shuffles.
BROADCAST_STRATA = 10_000


def words_of(text: Column) -> Column:
    """The runs of other than space and 09 to 0D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that occur at least twice in ``words``, a power of two.

    Window hashes come from word hashes by doubling. Only texts with an equal pair of hashes go on to find where they stand: hashes are sorted
    with their places, those with an equal neighbour are put back in order, and each adds what it reaches beyond the one before.
    """
    hashes, reach = F.transform(words, lambda w: F.xxhash64(w)), 1
    while reach < window:
        hashes = F.zip_with(hashes, F.slice(hashes, reach + 1, F.size(words)), lambda a, b: F.xxhash64(a, b))
        reach *= 2
    hashes = F.slice(hashes, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))

    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = F.filter(
            F.transform(
                F.arrays_zip(
                    pairs.alias("p"),
                    F.concat(F.array(F.lit(None).cast("bigint")), F.slice(pairs.getField("h"), 1, F.greatest(F.size(pairs) - 1, F.lit(0)))).alias("before"),
                    F.concat(F.slice(pairs.getField("h"), 2, F.size(pairs)), F.array(F.lit(None).cast("bigint"))).alias("after"),
                ),
                lambda x: F.when((x["p"]["h"] == x["before"]) | (x["p"]["h"] == x["after"]), x["p"]["i"]),
            ),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(twice)

    def covered(starts: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(starts, begin, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")))["n"]

    # a lambda binds the hashes once, whatever is asked of them
    return F.element_at(
        F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(places(h)))), 1
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.withColumn(
        "_stat",
        F.element_at(
            F.transform(
                F.array(words_of(F.col("text"))),
                lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
            ),
            1,
        ),
    )
    lines = F.filter(F.split(text, "\\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    duplicates = F.element_at(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 1)
    return counted.select(
        *[F.col(c) for c in docs.columns],
        F.col("_stat.n_words").alias("n_words"),
        F.col("_stat.word_chars").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        duplicates.cast("long").alias("n_dup_lines"),
        F.col("_stat.n_repeat_words").alias("n_repeat_words"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "\\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"),
    )


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_breaks")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The statistic of each rule, as a double."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "duplicate_lines_share": F.col("n_dup_lines") / (F.col("n_breaks") + 1).cast("double"),
        "word_length": F.col("word_chars") / words,
    }


def log_binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """ln P(Bin(n, p) <= k), exact but for rounding: terms are added from the largest (j = k, below the mean) down, each from the last.

    The ratio of term j - 1 to term j is j / (n - j + 1) * (1 - p) / p; ln C(n, k) is a sum of k logarithms.
    """
    log_choose = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, j: a + F.when(k > 0, F.ln((n - k + j) / j.cast("double"))).otherwise(0.0))
    top = log_choose + k * F.ln(p) + (n - k) * F.ln(1 - p)
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(a: Column, i: Column) -> Column:
        j = k - i + 1
        term = a["term"] * (j / (n - j + 1).cast("double")) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    below = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), begin, add)["total"]).otherwise(1.0)
    return F.when(k >= n * p, F.lit(0.0)).otherwise(top + F.ln(below))


def thresholds(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: ``stratum`` and a map ``cutoffs`` from rule to the strictest cutoff that is proven.

    ``stats``: doc_id, the stratum, and what ``with_statistics`` adds. Only documents that pass the base take part.
    """
    rules = list(GRIDS)
    good = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    cells = [F.sum((value > cutoff).cast("long")).alias(f"{rule}_{i}") for rule, value in measures().items() for i, cutoff in enumerate(GRIDS[rule])]
    passed = stats.filter(~base_failed()).join(good, "doc_id", "left_semi")
    # of rows of one id the greatest counts, in the order of these columns
    passed = passed.groupBy("doc_id").agg(F.max(F.struct(F.col(stratum).alias("stratum"), *STATISTICS)).alias("row")).select("row.*")
    counts = passed.groupBy("stratum").agg(F.count("*").alias("n"), *cells)
    grid = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cutoff).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule in rules for i, cutoff in enumerate(GRIDS[rule])]
    )
    tested = counts.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(1)))).select("stratum", "n", "strata", F.explode(grid).alias("g"))
    # as many rules as n labels without a false rejection would prove
    some = F.coalesce(*[F.when(F.col("n") * math.log1p(-alpha / r) <= F.ln(F.lit(delta) / (F.col("strata") * r)), F.lit(r)) for r in range(len(rules), 0, -1)], F.lit(len(rules)))
    tested = tested.withColumn("rules", some).filter(F.array_position(F.array(*map(F.lit, rules)), F.col("g.rule")) <= F.col("rules"))
    limit = F.ln(F.lit(delta) / (F.col("strata") * F.col("rules")))
    # enough of the tail is below the limit or not long before k reaches the mean; what cannot pass is not summed
    proven = log_binomial_tail(F.col("n"), F.col("g.k"), F.lit(alpha) / F.col("rules")) <= limit
    first_failure = F.coalesce(F.min(F.when(~F.col("proven"), F.col("g.step"))), F.lit(1 << 20))
    by_rule = (
        tested.withColumn("proven", proven)
        .groupBy("stratum", F.col("g.rule").alias("rule"))
        .agg(first_failure.alias("failed"), F.collect_list(F.struct("g.step", "g.cutoff")).alias("steps"))
        .withColumn("cutoff", F.array_min(F.transform(F.filter("steps", lambda s: s["step"] < F.col("failed")), lambda s: s["cutoff"])))
        .filter("cutoff IS NOT NULL")
    )
    return by_rule.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``stats`` with base_failed, kept, and ``failed_rules``, an array of the rules that reject the document."""
    same = F.col(stratum).eqNullSafe(F.col("_cut.stratum"))
    few = cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = stats.join((F.broadcast(cutoffs) if few else cutoffs).alias("_cut"), same, "left")
    fails = [F.when(value > F.col("_cut.cutoffs")[rule], F.lit(rule)) for rule, value in measures().items()]
    named = joined.select(*[stats[c] for c in stats.columns], F.array_compact(F.array(*fails)).alias("failed_rules"))
    named = named.withColumn("base_failed", base_failed())
    return named.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, the stratum, the statistics, base_failed, failed_rules, kept. Statistics are computed once."""
    stats = common.stage(with_statistics(docs).select("doc_id", stratum, *STATISTICS), "statistics")
    cutoffs = common.stage(thresholds(stats, labels, stratum, alpha, delta), "cutoffs")
    return judge(stats, cutoffs, stratum)


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; texts are not shuffled. Statistics are computed once, and staged beside the rows."""
    own = with_statistics(docs.select(F.struct(*docs.columns).alias("_row"), "text", "doc_id", stratum)).select("_row", "doc_id", stratum, *STATISTICS)
    stats = common.stage(own, "statistics")
    cutoffs = common.stage(thresholds(stats.drop("_row"), labels, stratum, alpha, delta), "cutoffs")
    return judge(stats, cutoffs, stratum).filter("kept").select("_row.*")
