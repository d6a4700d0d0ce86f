"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule measures one property of a text; larger is worse. Which cutoff a rule uses
is decided per stratum on labelled documents. The candidates of a rule are tried from
the mildest on; one is certified if, were the true share of good documents that it
rejects above the allowed risk, so few rejections among the labelled good ones would
have a binomial probability of at most the level. The first that is not certified ends
the row (a fixed sequence, so no further correction is due inside a rule); the level is
divided by the number of rules and strata (Bonferroni), and the allowed risk by the number of
rules. So with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good
documents to all rules together. A rule without a certified cutoff rejects nothing.

Edge cases: a null text has no words; a null stratum is one of its own; documents
without labels do not take part in the choice; of several labels for one id the best
counts; empty tables give an empty table or no certified cutoffs; repeated rows give
repeated rows; null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from srcloom.llm import common

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 5
#: Rule and its candidate cutoffs, the mildest first. A text is rejected above the cutoff.
CUTOFFS = {
    "symbol_ratio": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "repeat_ratio": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02],
    "mean_word": [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0],
    "shortness": [0.09, 0.08, 0.07, 0.06, 0.05, 0.04, 0.03, 0.025, 0.02],
}
ALPHA, DELTA = 0.05, 0.05


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def covered_words(hashes: Column) -> Column:
    """Words inside a run of ``GRAM`` words that occurs twice or more, from the words' hashes."""
    grams = bound(
        hashes,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - F.lit(GRAM)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)])
        ),
    )

    def cover(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        places = bound(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)),
            ),
        )
        return F.aggregate(
            F.sort_array(F.transform(places, lambda x: x["i"])),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct(
                (acc["n"] + GRAM - F.greatest(F.lit(0), acc["end"] - i)).cast("long").alias("n"), (i + GRAM).alias("end")
            ),
            lambda acc: acc["n"],
        )

    counted = bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(cover(g)))
    return F.when(F.size(hashes) > GRAM, counted).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, stratum: Column) -> DataFrame:
    """One row of counts per document; the text goes no further."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        stratum.cast("string").alias("stratum"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
    )
    counted = read.select(
        "doc_id", "stratum", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        F.col("lines.n").cast("long").alias("n_lines"), covered_words(F.col("hashes")).alias("n_repeat_words"),
    )
    return counted.withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
        "shortness": 1 / words,
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), summed from logarithms; 1 where k is not below the mean."""
    from math import log

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(log(p / (1 - p)))
        top = F.greatest(term, acc["total"])
        return F.struct(
            term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(acc["total"] - top))).alias("total")
        )

    first = n * F.lit(log(1 - p))
    summed = F.aggregate(
        F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), k.cast("long"))),
        F.struct(first.alias("term"), first.alias("total")),
        step,
        lambda acc: F.exp(acc["total"]),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(summed)


def certified_cutoffs(
    measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cutoffs: dict | None = None
) -> DataFrame:
    """(stratum, rule, cutoff): the boldest certified cutoff of every rule and stratum that has one."""
    cutoffs = cutoffs or CUTOFFS
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi")
    counts = held.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[
            F.count(F.when(measures()[rule] > cut, 1)).alias(f"{rule}_{j}")
            for rule, cuts in cutoffs.items()
            for j, cut in enumerate(cuts)
        ],
    )
    tried = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(j).alias("j"), F.lit(float(cut)).alias("cutoff"), F.col(f"{rule}_{j}").alias("k"))
            for rule, cuts in cutoffs.items()
            for j, cut in enumerate(cuts)
        ]
    )
    rows = counts.crossJoin(counts.agg(F.count("*").alias("strata")).hint("broadcast")).select("stratum", "n", "strata", F.inline(tried))
    level = F.lit(delta) / (F.lit(len(cutoffs)) * F.col("strata"))
    passed = binomial_tail(F.col("k"), F.col("n"), alpha / len(cutoffs)) <= level
    order = Window.partitionBy("stratum", "rule").orderBy("j")
    return (
        rows.withColumn("failed", F.sum(F.when(passed, 0).otherwise(1)).over(order))
        .where("failed = 0")
        .groupBy("stratum", "rule")
        .agg(F.min("cutoff").alias("cutoff"))
    )


def judge(
    docs: DataFrame, labels: DataFrame, stratum: Column | None = None, alpha: float = ALPHA, delta: float = DELTA, cutoffs: dict | None = None
) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    cutoffs = cutoffs or CUTOFFS
    measured = common.stage(features(docs, F.lit("all") if stratum is None else stratum), "features")
    chosen = certified_cutoffs(measured, labels, alpha, delta, cutoffs)
    # One row per stratum.
    wide = chosen.groupBy(F.col("stratum").alias("of")).agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in cutoffs]
    )
    rejected = F.lit(False)
    for rule in cutoffs:
        rejected = rejected | F.coalesce(measures()[rule] > F.col(f"cut_{rule}"), F.lit(False))
    return measured.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"), "stratum",
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL, over ``documents`` and ``labels`` with ``lang`` as the stratum."""
    tried = ", ".join(
        f"('{rule}', {j}, {float(cut)!r}::DOUBLE)" for rule, cuts in CUTOFFS.items() for j, cut in enumerate(cuts)
    )
    rules, p = len(CUTOFFS), ALPHA / len(CUTOFFS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i:i+4] AS gram FROM w, range(1, greatest(len(ws) - 3, 1)) t(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) s(k) GROUP BY r),
f AS (SELECT d.doc_id, d.stratum, len(ws) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
        n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word,
        1 / greatest(n_words, 1) AS shortness FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
v AS (SELECT stratum, rule, value FROM held, LATERAL (VALUES ('symbol_ratio', symbol_ratio), ('dup_line_ratio', dup_line_ratio),
        ('repeat_ratio', repeat_ratio), ('mean_word', mean_word), ('shortness', shortness)) x(rule, value)),
c AS (SELECT v.stratum, rule, j, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
      FROM v JOIN (VALUES {tried}) t(rule, j, cutoff) USING (rule) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) END
        <= {DELTA!r} / ({rules} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held))) AS passed FROM c),
chosen AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, sum(CASE WHEN passed THEN 0 ELSE 1 END)
        OVER (PARTITION BY stratum, rule ORDER BY j) AS failed FROM p) WHERE failed = 0 GROUP BY ALL),
wide AS (SELECT stratum AS of, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in CUTOFFS)} FROM chosen GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({r} > cut_{r}, false)" for r in CUTOFFS)}) AS kept, stratum
FROM m LEFT JOIN wide ON m.stratum IS NOT DISTINCT FROM wide.of
"""
