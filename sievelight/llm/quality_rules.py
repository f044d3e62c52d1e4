"""Quality rules whose cutoffs carry a guarantee.

A rule rejects a text when one of its rates is above a cutoff. The cutoffs come from labelled
holdout documents: for each stratum and rule, cutoffs are tried from loose to strict, and one is
certified while the exact binomial test rejects "more than ``risk`` of the good documents would be
rejected". Trying them in a fixed order until the first failure needs no correction within a rule;
the Bonferroni correction over all rules and strata covers the rest. Of the certified cutoffs, the one
with the largest gain is used, the loosest of equals: the share of bad documents it rejects less ``cost`` times the
share of good ones, so clean texts are not spent up to the allowed risk. Everything is built-in SQL functions.

With ``joint`` the rules are certified together instead: one fixed sequence of cutoff vectors for each stratum, one
test of the documents that any rule rejects, at the full ``risk`` and a level divided by strata alone. The
sequence comes from the bad and the unlabelled documents, so the good ones that test it had no part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Cutoffs that are tried, loosest first.
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
RULES = {
    "symbols": "n_symbols / word_chars",
    "capitals": "n_capitals / word_chars",
    "lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def text_counts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each text, rows ``id, *keep, n_words, ...``; null texts count as empty.

    ``word_chars`` code points in words, ``n_symbols`` of ``#*$%&|<>``, ``n_capitals`` upper-case
    letters, ``n_lines`` lines with a word, ``n_dup_lines`` those equal to an earlier line,
    ``n_repeat_words`` words covered by 8-word windows that occur twice or more in the text.
    Windows are compared by 64-bit hash. Work and memory are linear in the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        id,
        *keep,
        body.alias("_text"),
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("_words"),
    )
    # generators of one row keep the costly columns from being computed again in each use
    once = split.select(
        id, *keep, F.inline(F.array(F.struct("_text", "_words")))
    )
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    counted = once.select(
        id,
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.inline(
            F.array(F.struct(lines.alias("_lines"), window_hashes("_words").alias("_windows")))
        ),
    )
    return counted.select(
        id,
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0))
        .otherwise(covered("_windows"))
        .cast("long")
        .alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_capitals",
    )


def window_hashes(words: str, width: int = 8) -> Column:
    """Hash of each window of ``width`` words, in order; none for shorter texts."""
    first = F.sequence(F.lit(1), F.size(words) - (width - 1))
    return F.when(
        F.size(words) >= width,
        F.transform(first, lambda i: F.xxhash64(F.slice(words, i, F.lit(width)))),
    ).otherwise(F.array().cast("array<bigint>"))


def covered(windows: str, width: int = 8) -> Column:
    """Words under windows whose hash occurs more than once."""
    return F.expr(
        f"""
        aggregate(
            sort_array(transform(
                element_at(transform(
                    array(sort_array(transform({windows}, (h, i) -> struct(h as h, i as i)))),
                    r -> filter(r, (x, k) -> (k > 0 and get(r, k - 1).h = x.h)
                        or (k + 1 < size(r) and get(r, k + 1).h = x.h))), 1),
                x -> x.i)),
            struct(0 as n, 0 as e),
            (a, x) -> struct(a.n + x + {width} - greatest(x, a.e) as n, x + {width} as e),
            a -> a.n)"""
    )


def base_failed(min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    """The fixed rules: too short, or too many of the words in repeated windows."""
    return (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )


def rates(rules: dict[str, str] = RULES) -> dict[str, Column]:
    """The rate of each rule; null where its denominator is 0, and then the rule is silent."""
    return {
        name: F.try_divide(*[F.col(c.strip()).cast("double") for c in ratio.split("/")])
        for name, ratio in rules.items()
    }


def certified_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    stratum: str,
    *,
    id: str = "doc_id",
    rules: dict[str, str] = RULES,
    grid: tuple[float, ...] = GRID,
    risk: float = 0.05,
    delta: float = 0.05,
    cost: float = 20.0,
) -> DataFrame:
    """One row ``_stratum`` and one column for each rule: its cutoff, null where none is certified.

    With probability ``1 - delta`` no stratum loses more than ``risk`` of its good documents to
    the rules together (each rule has an equal part of both). ``labels`` has ``id, quality``: 1 is good,
    0 bad, null is left out; of repeated labels the lowest holds. Without labels no
    rule gets a cutoff. All labels are used.
    """
    part, steps = risk / len(rules), range(len(grid))
    known = labels.where("quality is not null").groupBy(id).agg(F.min("quality").alias("_quality"))
    rows = (
        counts.where(~base_failed())
        .select(id, stratum_of(stratum), *[r.alias(f"_r_{n}") for n, r in rates(rules).items()])
        .join(known, id)
    )
    # one row per labelled document and rule: the first cutoff that rejects it
    first = lambda v: F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: ~(v > c)))
    long = rows.select(
        "_stratum",
        (F.col("_quality") == 1).alias("_good"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("_rule"), F.coalesce(F.col(f"_r_{n}"), F.lit(0.0)).alias("_v"))
                    for n in rules
                ]
            )
        ),
    ).withColumn("_first", first(F.col("_v")))
    totals = long.groupBy("_stratum", "_rule").agg(
        F.sum(F.col("_good").cast("long")).alias("n"),
        F.sum((~F.col("_good")).cast("long")).alias("m"),
        F.array(*[F.sum((F.col("_good") & (F.col("_first") <= j)).cast("long")) for j in steps]).alias("k"),
        F.array(*[F.sum((~F.col("_good") & (F.col("_first") <= j)).cast("long")) for j in steps]).alias("b"),
    )
    every = Window.partitionBy()
    tests = totals.withColumn("_strata", F.size(F.collect_set("_stratum").over(every)))
    level = F.lit(delta / len(rules)) / F.col("_strata")
    tested = tests.withColumn(
        "_sure", F.transform("k", lambda k: binomial_tail(F.col("n"), k, part) <= level)
    )
    # fixed order: certified up to the first test that fails
    stop = F.array_position("_sure", F.lit(False))
    sure = F.when(stop > 0, stop - 1).otherwise(len(grid)).cast("int")
    gain = F.transform(
        F.arrays_zip("k", "b"),
        lambda x: F.coalesce(
            F.try_divide(x["b"], F.col("m")) - F.lit(cost) * F.try_divide(x["k"], F.col("n")), F.lit(0.0)
        ),
    )
    picked = (
        tested.withColumn("_gain", F.slice(gain, F.lit(1), sure))
        .withColumn("_best", F.array_max("_gain"))
        .withColumn(
            "_cutoff",
            F.when(
                F.col("_best") > 0,
                F.element_at(
                    F.array(*map(F.lit, grid)), F.array_position("_gain", F.col("_best")).cast("int")
                ),
            ),
        )
    )
    return picked.groupBy("_stratum").agg(
        *[F.max(F.when(F.col("_rule") == n, F.col("_cutoff"))).alias(f"_c_{n}") for n in rules]
    )


def joint_cutoffs(
    counts: DataFrame,
    labels: DataFrame,
    stratum: str,
    *,
    id: str = "doc_id",
    rules: dict[str, str] = RULES,
    grid: tuple[float, ...] = GRID,
    risk: float = 0.05,
    delta: float = 0.05,
    cost: float = 20.0,
) -> DataFrame:
    """Like ``certified_cutoffs`` with the same guarantee, the rules of a stratum certified together.

    A step lowers the cutoff of one rule. Steps that reject no bad document are left out; the others are taken
    by the share of bad documents they reject over that of unlabelled ones, largest first. Without unlabelled
    documents they go from loose to strict. A stratum gets cutoffs from ``log(delta / strata) / log(1 - risk)``
    labelled good documents on: 86 for 4 strata. Strata without cutoffs may be missing.
    """
    size = len(grid)
    known = labels.where("quality is not null").groupBy(id).agg(F.min("quality").alias("_quality"))
    first = lambda v: F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: ~(v > c)))
    rows = counts.where(~base_failed()).select(
        id,
        stratum_of(stratum),
        F.array(*[first(F.coalesce(r, F.lit(0.0))).cast("tinyint") for r in rates(rules).values()]).alias("_firsts"),
    )
    # rows that the steps cannot tell apart are counted together
    cells = staged(
        rows.join(known, id, "left").groupBy("_stratum", "_quality", "_firsts").agg(F.count("*").alias("_rows")),
        "rule-cells",
        narrow=True,
    )
    number = lambda kind: F.sum(F.when(kind, F.col("_rows")).otherwise(0))
    good, bad = F.coalesce(F.col("_quality") == 1, F.lit(False)), F.coalesce(F.col("_quality") != 1, F.lit(False))
    other = F.col("_quality").isNull()
    rejects = lambda step: F.get("_firsts", F.floor(step / size).cast("int")) <= step % size
    steps = (
        cells.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(rules) * size - 1))))
        .groupBy("_stratum", "_step")
        .agg(
            number(bad & rejects(F.col("_step"))).alias("b"),
            number(other & rejects(F.col("_step"))).alias("u"),
            number(bad).alias("m"),
            number(other).alias("_others"),
            number(~other).alias("_known"),
        )
    )
    lift = F.when(F.col("_others") > 0, F.try_divide(F.col("b"), F.col("m")) * (F.col("_others") + 1) / (F.col("u") + 0.5))
    rank = F.struct((-F.coalesce(lift, F.lit(0.0))).alias("lift"), (F.col("_step") % size).alias("at"), "_step")
    orders = (
        steps.groupBy("_stratum")
        .agg(F.array_sort(F.collect_list(F.when(F.col("b") > 0, rank))).alias("_ranks"), F.max("_known").alias("_known"))
        .where("_known > 0")
        .withColumn("_strata", F.count("*").over(Window.partitionBy()))
        .where(F.size("_ranks") > 0)
        .select("_stratum", "_strata", F.transform("_ranks", lambda r: r["_step"]).alias("_order"))
    )
    # the first step of the sequence that rejects a row, 0 if none does
    at = F.array_position(F.transform("_order", rejects), F.lit(True))
    totals = (
        cells.where(~other)
        .join(orders, "_stratum")
        .groupBy("_stratum", "_strata", "_order", at.alias("_at"))
        .agg(number(good).alias("k"), number(bad).alias("b"))
        .groupBy("_stratum", "_strata", "_order")
        .agg(F.sum("k").alias("n"), F.sum("b").alias("m"), F.collect_list(F.struct("_at", "k", "b")).alias("_hits"))
    )
    up_to = lambda name: F.transform(
        F.sequence(F.lit(1), F.size("_order")),
        lambda t: F.aggregate(
            F.filter("_hits", lambda x: (x["_at"] > 0) & (x["_at"] <= t)),
            F.lit(0).cast("long"),
            lambda a, x: a + x[name],
        ),
    )
    tested = totals.withColumn("_k", up_to("k")).withColumn("_b", up_to("b")).withColumn(
        "_sure",
        F.transform("_k", lambda k: binomial_tail(F.col("n"), k, risk) <= F.lit(delta) / F.col("_strata")),
    )
    # fixed order: certified up to the first test that fails
    stop = F.array_position("_sure", F.lit(False))
    sure = F.when(stop > 0, stop - 1).otherwise(F.size("_order")).cast("int")
    gain = F.transform(
        F.arrays_zip("_k", "_b"),
        lambda x: F.coalesce(
            F.try_divide(x["_b"], F.col("m")) - F.lit(cost) * F.try_divide(x["_k"], F.col("n")), F.lit(0.0)
        ),
    )
    picked = (
        tested.withColumn("_gain", F.slice(gain, F.lit(1), sure))
        .withColumn("_best", F.array_max("_gain"))
        .where("_best > 0")
        .withColumn("_taken", F.slice("_order", F.lit(1), F.array_position("_gain", F.col("_best")).cast("int")))
    )

    def cutoff(rule: int) -> Column:
        own = F.filter("_taken", lambda step: F.floor(step / size) == rule)
        return F.get(F.array(*map(F.lit, grid)), (F.array_max(own) % size).cast("int"))

    return picked.select("_stratum", *[cutoff(i).alias(f"_c_{n}") for i, n in enumerate(rules)])


def stratum_of(column: str) -> Column:
    """The stratum; null counts as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_stratum")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p); 1 where k is not below the mean.

    The largest term, at k, comes from the log-gamma function; the terms below it shrink
    geometrically and are summed down to where they no longer count in double precision.
    """
    x = k.cast("double")
    total = n.cast("double")
    top = (
        log_gamma(total + 1)
        - log_gamma(x + 1)
        - log_gamma(total - x + 1)
        + x * F.log(F.lit(p))
        + (total - x) * F.log1p(F.lit(-p))
    )
    terms = F.least(k, (F.ceil(F.sqrt(total * p) * 40) + 50).cast("long"))
    odds = (1 - p) / p
    below = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct(
            (a["t"] * (x - i) / (total - x + i + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")
        ),
        lambda a: a["s"],
    )
    return F.when(x < total * p, F.exp(top) * below).otherwise(F.lit(1.0))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series after eight steps up."""
    steps = F.log(x)
    for i in range(1, 8):
        steps = steps + F.log(x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - steps


def judged(
    counts: DataFrame, cutoffs: DataFrame, stratum: str, rules: dict[str, str] = RULES
) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``; a stratum without cutoffs has only the base."""
    placed = counts.withColumn("_stratum", stratum_of(stratum)).join(cutoffs, "_stratum", "left")
    broken = F.lit(False)
    for name, rate in rates(rules).items():
        broken = broken | F.coalesce(rate > F.col(f"_c_{name}"), F.lit(False))
    return placed.select(
        *[F.col(f"`{c}`") for c in counts.columns],
        base_failed().alias("base_failed"),
        (~base_failed() & ~broken).alias("kept"),
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    risk: float = 0.05,
    delta: float = 0.05,
    joint: bool = False,
) -> DataFrame:
    """Counts and verdict of every row of ``docs``; texts are read once.

    Null texts count as empty and fail the base, rows that repeat are judged one by one, null
    ids are kept but match no label. An empty table gives an empty result. Other columns of
    ``docs`` are not read, whatever their names. ``joint``: rules are certified together, which needs
    far fewer labels in a stratum.
    """
    chosen = docs.select(F.col(id), F.col(stratum).alias("_lang"), F.col(text).alias("_body"))
    counts = staged(text_counts(chosen, id=id, text="_body", keep=("_lang",)), "rule-counts", narrow=True)
    certify = joint_cutoffs if joint else certified_cutoffs
    cutoffs = staged(certify(counts, labels, "_lang", id=id, risk=risk, delta=delta), "rule-cutoffs", narrow=True)
    return judged(counts, cutoffs, "_lang").drop("_lang")
