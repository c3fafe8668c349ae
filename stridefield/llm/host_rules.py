"""Quality rules judged per document and per host, in Spark expressions only.

Rules of a document are counted inside its row. Failures are then aggregated by host (the
``source`` column), each host's failure rate is shrunk towards the others with an empirical beta
prior (method of moments over hosts), and the host's verdict is joined back to its documents.

Shuffles: partial counts per host, then the host join. The host table has one row per host; Spark's
own size threshold decides whether it is broadcast, otherwise AQE splits a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Rules judged by host: the two of base_failed, over a symbol in ten words, over a repeated line in twenty words.
RULES = ("short", "repeats", "symbols", "same_lines")


def words_of(text: Column) -> Column:
    """The words of a text in order: runs without white space. A column expression: no key, no shuffle."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the array (first one included).

    Windows are sorted with their positions, so equal ones become neighbours; then every word
    position is counted once even where windows overlap.
    """
    windows = F.size(words) - 2
    grams = F.when(
        windows > 1,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), windows - 1),
                lambda i: F.struct(
                    F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("g"),
                    i.alias("i"),
                ),
            )
        ),
    ).otherwise(F.array().cast("array<struct<g:string,i:int>>"))
    return grams


def _covered(grams: Column) -> Column:
    repeated = F.sort_array(
        F.transform(
            F.filter(
                F.zip_with(
                    grams,
                    F.slice(grams, 2, F.greatest(F.size(grams), F.lit(1))),
                    lambda a, b: F.struct(a["i"].alias("a"), F.when(a["g"] == b["g"], b["i"]).alias("b")),
                ),
                lambda p: p["b"].isNotNull(),
            ),
            lambda p: F.array(p["a"], p["b"]),
        )
    )
    return F.array_sort(F.array_distinct(F.flatten(repeated)))


def _covered_count(at: Column) -> Column:
    gaps = F.zip_with(
        at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))
    )
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)


def rule_counts(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and the flags in RULES.

    A null or empty text has no words, characters or lines, so it fails by n_words < 50. Existing columns of
    these names are replaced, all others stay, whatever their names. No shuffle: each text is read inside its row, whole.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    short = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
        .withColumn("_words", words_of(text))
        .withColumn("_lines", lines)
        .withColumn("_grams", repeated_words(F.col("_words")))
        .withColumn("_at", _covered(F.col("_grams")))
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": _covered_count(F.col("_at")).cast("long"),
            }
        )
        .select(
            *[F.col(f"_doc.`{c}`") for c in docs.columns if c not in (*counts, "base_failed", *RULES)],
            *counts,
            (short | repeats).alias("base_failed"),
            short.alias("short"),
            repeats.alias("repeats"),
            (10 * F.col("n_symbols") > F.col("n_words")).alias("symbols"),
            (20 * F.col("n_dup_lines") > F.col("n_words")).alias("same_lines"),
        )
    )


def host_verdicts(flags: DataFrame, host: str = "source", least_rate: float = 0.3, deviations: float = 2.0) -> DataFrame:
    """One row per host: _host, n_docs, for each rule of RULES its shrunk rate ``<rule>_rate``, and host_kept.

    The beta prior of a rule is fitted to the hosts' rates by moments: with mean m and variance v of the rates,
    strength s = m(1-m)/v - 1 (at least 1, at most 1e6; 1 where all rates agree at 0 or 1). The shrunk rate is
    (failed + m*s) / (docs + s). A host is refused if the rate of any rule is over ``least_rate`` and also further above m than
    ``deviations`` standard deviations of the prior. A null host is a host of its own; a null flag counts as not failed.
    """
    per_host = flags.groupBy(F.col(host).alias("_host")).agg(
        F.count("*").alias("n_docs"), *[F.coalesce(F.sum(F.col(r).cast("long")), F.lit(0)).alias(r) for r in RULES]
    )
    moments = [f(F.col(r) / F.col("n_docs")).alias(f"_{n}_{r}") for r in RULES for n, f in (("m", F.avg), ("v", F.var_pop))]
    # the prior is one row: an aggregate without keys
    known = per_host.withColumn("_one", F.lit(1)).join(F.broadcast(per_host.agg(*moments).withColumn("_one", F.lit(1))), "_one")
    kept = F.lit(True)
    for r in RULES:
        m, v = F.col(f"_m_{r}"), F.col(f"_v_{r}")
        strength = F.when(v > 0, F.least(F.lit(1e6), F.greatest(F.lit(1e0), m * (1 - m) / v - 1))).otherwise(
            F.when((m > 0) & (m < 1), F.lit(1e6)).otherwise(F.lit(1e0))
        )
        known = known.withColumn(f"_s_{r}", strength)
        known = known.withColumn(f"{r}_rate", (F.col(r) + m * F.col(f"_s_{r}")) / (F.col("n_docs") + F.col(f"_s_{r}")))
        limit = F.greatest(F.lit(least_rate), m + deviations * F.sqrt(m * (1 - m) / (F.col(f"_s_{r}") + 1)))
        kept = kept & (F.col(f"{r}_rate") <= limit)
    return known.select("_host", "n_docs", *[f"{r}_rate" for r in RULES], kept.alias("host_kept"))


def judge(counted: DataFrame, host: str = "source", **limits) -> DataFrame:
    """``counted`` (from :func:`rule_counts`) plus kept = not base_failed and the host is kept (:func:`host_verdicts`).

    An existing column kept is replaced, all others stay.
    """
    rows = counted.select(F.struct(*[F.col(f"`{c}`") for c in counted.columns]).alias("_doc"), F.col(host).alias("_at"), F.col("base_failed").alias("_failed"))
    hosts = host_verdicts(counted.select(host, *RULES), host, **limits).select("_host", "host_kept")
    joined = rows.join(hosts, F.col("_at").eqNullSafe(F.col("_host")), "left")
    return joined.select(*[F.col(f"_doc.`{c}`") for c in counted.columns if c != "kept"], (~F.col("_failed") & F.col("host_kept")).alias("kept"))
