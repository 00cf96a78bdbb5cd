"""Text statistics and robust multivariate outliers among the texts of a language and source.

Five statistics of a text are transformed to logarithms. For each group a minimum covariance determinant
estimate is sought by concentration steps: from medians, the three quarters of
the rows that lie nearest by Mahalanobis distance give the next mean and covariance. Distances
are cut at a quantile of a histogram (64 bins for each factor e), which merges map-side, so
no group is sorted or gathered; a third of all rows in one source is a few rows
of each task. Covariances carry a small ridge, as most texts have no symbol and no repeat.
Texts beyond ``CUTOFF`` (chi-square, 5 degrees) from the estimate, scaled to the
median distance, are rejected.

Groups of fewer than ``MIN_GROUP`` texts use the estimate of their language, and languages that small
that of all texts. Estimates are fitted on texts that pass the base rules.

Rows: a null text has no words and fails the base rules, as does an empty one; a null
language or source is a group like any other; repeated rows count each; an empty table gives no rows.
Extra columns are kept, but those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import let, stored

SPACE = r"[\x20\x09-\x0D]+"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CUTOFF = 50.5  # chi-square with 5 degrees at 1 - 1e-9, as the tails of text statistics are heavier than normal
CHI_MEDIAN = 4.351
KEPT_SHARE = 0.75
MIN_GROUP = 100
RIDGE = (0.5, 0.08, 0.6, 0.6, 0.9)  # standard deviations that every group has at least
STEPS = 6
SETTLED = 1e-3
BINS = 64
P = range(len(STATISTICS))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has more than once."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, k: F.when(k == F.size(places) - 1, 3).otherwise(F.least(F.lit(3), places[k + 1] - p))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def repeated(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        twins = F.transform(
            ordered,
            lambda s, k: F.when(
                ((k > 0) & (ordered[F.greatest(k - 1, F.lit(0))]["h"] == s["h"]))
                | ((k < last) & (ordered[F.least(k + 1, last)]["h"] == s["h"])),
                s["i"],
            ),
        )
        return let(F.sort_array(F.filter(twins, lambda i: i.isNotNull())), covered)

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, repeated))

    return let(windows, counted)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the five statistics and ``base_failed``."""
    docs = docs.drop(*STATISTICS, "base_failed")
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    facts = F.struct(
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    known = docs.withColumn("_facts", facts)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return known.select(
        *docs.columns,
        "_facts.w.n_words",
        "_facts.w.word_chars",
        "_facts.n_symbols",
        "_facts.n_dup_lines",
        "_facts.w.n_repeat_words",
    ).withColumn("base_failed", failed)


def transformed(df: DataFrame) -> DataFrame:
    words = F.col("n_words") + 1
    return df.withColumns(
        {
            "_x0": F.log(words),
            "_x1": F.log((F.col("word_chars") + 1) / words),
            "_x2": F.log(1 + 100 * F.col("n_symbols") / words),
            "_x3": F.log(1.0 + F.col("n_dup_lines")),
            "_x4": F.log(1 + 100 * F.col("n_repeat_words") / words),
        }
    )


def _cholesky(estimates: DataFrame) -> DataFrame:
    """Lower factor _l{i}_{k} of each group's covariance _s{i}_{k}."""
    out = estimates
    for k in P:
        own = F.col(f"_s{k}_{k}") - sum((F.col(f"_l{k}_{j}") ** 2 for j in range(k)), F.lit(0.0))
        out = out.withColumn(f"_l{k}_{k}", F.sqrt(F.greatest(own, F.lit(RIDGE[k] ** 2 / 4))))
        below = {
            f"_l{i}_{k}": (
                F.col(f"_s{i}_{k}") - sum((F.col(f"_l{i}_{j}") * F.col(f"_l{k}_{j}") for j in range(k)), F.lit(0.0))
            )
            / F.col(f"_l{k}_{k}")
            for i in P
            if i > k
        }
        out = out.withColumns(below) if below else out
    return out.drop(*(f"_s{i}_{k}" for i in P for k in range(i + 1)))


def _distances(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Rows with the squared distance _d2 to their group's estimate."""
    out = rows.join(factors, "_group")
    for i in P:
        rest = F.col(f"_x{i}") - F.col(f"_m{i}") - sum((F.col(f"_l{i}_{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"_z{i}", rest / F.col(f"_l{i}_{i}"))
    out = out.withColumn("_d2", sum((F.col(f"_z{i}") ** 2 for i in P), F.lit(0.0)))
    return out.select(*rows.columns, "_d2", F.floor(F.log(F.col("_d2") + 1e-6) * BINS).cast("int").alias("_bin"))


def _quantile_bins(near: DataFrame, share: float, name: str) -> DataFrame:
    """Per group the first bin up to which ``share`` of its rows lie."""
    bins = near.groupBy("_group", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy("_group").orderBy("_bin")
    running = bins.withColumn("_run", F.sum("_n").over(in_order)).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy("_group"))
    )
    return running.filter(F.col("_run") >= F.col("_all") * share).groupBy("_group").agg(F.min("_bin").alias(name))


def _moments(rows: DataFrame) -> DataFrame:
    means = [F.avg(f"_x{i}").alias(f"_m{i}") for i in P]
    covariances = [
        (F.covar_pop(f"_x{i}", f"_x{k}") + (RIDGE[i] ** 2 if i == k else 0.0)).alias(f"_s{i}_{k}")
        for i in P
        for k in range(i + 1)
    ]
    return rows.groupBy("_group").agg(*means, *covariances)


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and absolute deviations from them on the diagonal."""
    rounded = rows.select("_group", *(F.round(f"_x{i}", 2).alias(f"_x{i}") for i in P))
    medians = rounded.groupBy("_group").agg(*(F.median(f"_x{i}").alias(f"_m{i}") for i in P))
    off = rounded.join(medians, "_group")
    spread = off.groupBy("_group").agg(*(F.median(F.round(F.abs(F.col(f"_x{i}") - F.col(f"_m{i}")), 2)).alias(f"_a{i}") for i in P))
    both = medians.join(spread, "_group")
    diagonal = {
        f"_s{i}_{k}": (1.4826 * F.col(f"_a{i}")) ** 2 + RIDGE[i] ** 2 if i == k else F.lit(0.0)
        for i in P
        for k in range(i + 1)
    }
    return both.withColumns(diagonal).drop(*(f"_a{i}" for i in P))


def fit(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Stored estimate of each _group: means, factors and the scale _scale of distances."""
    factors = stored(_cholesky(_start(rows)))
    last = None
    for _ in range(steps):
        near = _distances(rows, factors)
        inner = near.join(_quantile_bins(near, KEPT_SHARE, "_edge"), "_group").filter(F.col("_bin") <= F.col("_edge"))
        factors = stored(_cholesky(_moments(inner)))
        determinant = sum((F.log(F.col(f"_l{i}_{i}")) for i in P), F.lit(0.0))
        now = factors.agg(F.sum(determinant)).first()[0]
        if now is None or last is not None and abs(last - now) <= SETTLED * max(1.0, abs(last)):
            break
        last = now
    middle = _quantile_bins(_distances(rows, factors), 0.5, "_edge")
    scale = F.exp((F.col("_edge") + 1) / BINS) / CHI_MEDIAN
    return stored(factors.join(middle.select("_group", scale.alias("_scale")), "_group"))


def _grouped(df: DataFrame) -> DataFrame:
    """Rows with the names of their own group, their language's and the one of all."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in ("lang", "source"))
    return df.withColumns(
        {"_own": F.concat(F.lit("s"), F.length(lang), lang, source), "_lang": F.concat(F.lit("l"), lang), "_all": F.lit("a")}
    )


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (with lang, source, text) with statistics, ``base_failed``, ``distance`` and ``kept``.

    The text is read once; what follows works on a stored table without it, so a caller
    that wants texts joins them by its key.
    """
    others = [c for c in docs.columns if c not in ("text", "distance", "kept", "base_failed", *STATISTICS)]
    measured = with_statistics(docs)
    rows = stored(_grouped(transformed(measured)).drop("text"))
    fitted = rows.filter(~F.col("base_failed"))
    sizes = fitted.groupBy("_own", "_lang", "_all").agg(F.count(F.lit(1)).alias("_n"))
    by_lang = sizes.groupBy("_lang").agg(F.sum("_n").alias("_in_lang"))
    names = rows.select("_own", "_lang", "_all").distinct()
    choice = (
        names.join(sizes.select("_own", "_n"), "_own", "left")
        .join(by_lang, "_lang", "left")
        .select(
            "_own",
            F.when(F.col("_n") >= MIN_GROUP, F.col("_own"))
            .when(F.col("_in_lang") >= MIN_GROUP, F.col("_lang"))
            .otherwise(F.col("_all"))
            .alias("_group"),
        )
    )
    choice = stored(choice)
    xs = [f"_x{i}" for i in P]
    memberships = fitted.select(F.explode(F.array("_own", "_lang", "_all")).alias("_group"), *xs)
    estimates = fit(stored(memberships.join(choice.select("_group").distinct(), "_group", "left_semi")))
    chosen = rows.join(choice, "_own")
    judged = _distances(chosen, estimates.drop("_scale")).join(estimates.select("_group", "_scale"), "_group")
    distance = F.when(~F.col("base_failed"), F.col("_d2") / F.col("_scale"))
    keys = chosen.join(estimates.select("_group"), "_group", "left_anti")
    known = judged.select(*others, *STATISTICS, "base_failed", distance.alias("distance"))
    # Where no text at all passes the base rules there is no estimate, and nothing is kept.
    rest = keys.select(*others, *STATISTICS, "base_failed", F.lit(None).cast("double").alias("distance"))
    return known.unionByName(rest).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))
