"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once for each document and keeps the measurements and
one failure bit per rule. Policies are versioned sets of rules: applying one is a bitwise
AND on the ledger, and ``ablation`` counts what each rule of a policy rejects alone from
the histogram of bit patterns, so no text is read again.

Everything is computed within a row; nothing is shuffled but the pattern histogram.

Defined cases: a null text counts as the empty text (no words, so it fails ``too_short``);
rows are judged one by one, so repeated rows get equal verdicts and null ids pass through;
an empty table gives an empty ledger; further columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules by bit, with the condition under which a document fails.
RULES: dict[str, str] = {
    "too_short": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 40 * n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("too_short", "repeated_windows")

#: Policies by version. A document is kept if none of the policy's bits is set.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbol_heavy"),
    "v2": (*BASE, "symbol_heavy", "shouting", "repeated_lines", "long_words"),
}
DEFAULT_POLICY = "v2"


def mask(policy: str) -> int:
    return sum(BITS[rule] for rule in POLICIES[policy])


def _repeat_words(hashes: Column, repeated: Column) -> Column:
    """Words within the windows whose hash occurs twice or more.

    Sorting (hash, position) brings equal windows together; the sorted positions of the
    repeated ones then cover ``min(WINDOW, gap)`` words each, without a quadratic scan."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(repeated, ordered)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(
        F.col(id_col),
        text.alias("_text"),
        F.array_remove(F.split(text, SPACE, -1), "").alias("_words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    hashed = words.select(
        id_col,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = hashed.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_hashes") - WINDOW),
                lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("_hashes")
    repeats = windows.withColumn("_repeated", F.size("_windows") > F.size(F.array_distinct("_windows")))
    ordered = repeats.withColumn("_ordered", _repeat_words(F.col("_windows"), F.col("_repeated"))).drop("_windows")
    same = F.filter(
        "_ordered",
        lambda x, i: ((i > 0) & (F.try_element_at("_ordered", F.greatest(i, F.lit(1))).h == x.h))
        | ((i + 1 < F.size("_ordered")) & (F.try_element_at("_ordered", i + 2).h == x.h)),
    )
    places = ordered.withColumn(
        "_places", F.when(F.col("_repeated"), F.sort_array(F.transform(same, lambda x: x.i)))
    ).drop("_ordered")
    gaps = F.zip_with(
        F.slice("_places", 2, F.size("_places") - 1),
        F.slice("_places", 1, F.size("_places") - 1),
        lambda later, at: F.least(F.lit(WINDOW), later - at),
    )
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    return places.withColumn(
        "n_repeat_words", F.when(F.col("_repeated"), covered).otherwise(0).cast("long")
    ).drop("_places", "_repeated")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``failed`` (one bit per rule of ``RULES``)."""
    bits = [F.when(F.expr(condition), F.lit(BITS[rule])).otherwise(0) for rule, condition in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measures(docs, id_col, text_col).withColumn("failed", failed.cast("long"))


def apply_policy(ledger_df: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's ``kept``."""
    return ledger_df.withColumn("base_failed", F.col("failed").bitwiseAND(mask("base")) != 0).withColumn(
        "kept", F.col("failed").bitwiseAND(mask(policy) | mask("base")) == 0
    )


def ablation(ledger_df: DataFrame) -> DataFrame:
    """For each policy and rule: documents that fail it, that fail it alone, and that are
    kept with and without it. Reads only the histogram of at most 2^rules bit patterns."""
    patterns = ledger_df.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).alias("mask"), F.lit(BITS[r]).alias("bit"))
        for p, rules in POLICIES.items()
        for r in rules
    ]
    wide = patterns.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask").cast("long"))
    bit = F.col("bit").cast("long")

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    return wide.groupBy("policy", "rule").agg(
        count(F.col("failed").bitwiseAND(bit) != 0).alias("n_failed"),
        count(hit == bit).alias("n_failed_alone"),
        count(hit == 0).alias("n_kept"),
        count((hit == 0) | (hit == bit)).alias("n_kept_without"),
    )


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """``docs`` (columns of ``documents``) without the rows that the policy rejects."""
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text"))
    # A filter is pushed below projections by substituting their expressions, each as often
    # as it is named, which would repeat the whole ledger many times over. It is not pushed
    # below a column that numbers rows.
    judged = apply_policy(ledger(whole, "_row", "text"), policy).withColumn("_place", F.monotonically_increasing_id())
    return judged.where("kept AND _place >= 0").select(*[F.col("_row")[c].alias(c) for c in columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents")))


_LEDGER_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS i FROM w)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
gap AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS k
        FROM dup WHERE c > 1),
rep AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS r FROM gap GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
ledger AS (SELECT *, CAST({' | '.join(f'(CASE WHEN {c} THEN {BITS[r]} ELSE 0 END)' for r, c in RULES.items())} AS BIGINT) AS failed FROM m)
"""

OP2_SQL = f"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {mask('base')}) <> 0 AS base_failed, (failed & {mask(DEFAULT_POLICY) | mask('base')}) = 0 AS kept, failed
FROM ledger"""

ABLATION_SQL = f"""{_LEDGER_SQL},
cases(policy, rule, mask, bit) AS (VALUES {', '.join(f"('{p}', '{r}', {mask(p)}, {BITS[r]})" for p, rules in POLICIES.items() for r in rules)})
SELECT policy, rule, count(*) FILTER (WHERE (failed & bit) <> 0) AS n_failed,
       count(*) FILTER (WHERE (failed & mask) = bit) AS n_failed_alone,
       count(*) FILTER (WHERE (failed & mask) = 0) AS n_kept,
       count(*) FILTER (WHERE (failed & mask) IN (0, bit)) AS n_kept_without
FROM ledger CROSS JOIN cases GROUP BY policy, rule"""
