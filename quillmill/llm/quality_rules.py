"""Quality rules: statistics of whole texts, and a learned decision list over them.

The statistics are Spark expressions evaluated in one narrow pass over the texts, with no shuffle of words: windows of five
words are hashed inside the row. A decision list for "drop" is then learned by sequential covering: each rule is grown one
threshold at a time on two thirds of the labelled rows, pruned on the rest, and the rows it covers are removed. It comes out
as one ordered CASE expression. Candidate thresholds are counted by DataFrame aggregations over at most ``max_labelled``
labelled rows, so the driver only ever sees the counts of some hundred candidates.

Defined results: a null text counts as empty (all statistics 0, base_failed true). Repeated rows get equal results, one each.
With no labelled row, or with one class only, no rule is learned and all that passes the base rules is kept. Columns of the
input other than id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_chars, materialise, values, words

WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: name and expression over the statistics.
FEATURES: dict[str, str] = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _repeated(pairs: Column) -> Column:
    """pairs: sorted (hash, position) of windows. Positions, ascending, of those whose hash occurs twice or more."""
    same = lambda e, j: F.coalesce(e["h"] == F.get(pairs, j)["h"], F.lit(False))
    hit = F.transform(pairs, lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]))
    return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and statistics of each row's whole text."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = base.select(
        "doc_id",
        words(F.col("_text")).alias("_w"),
        lines.alias("_lines"),
        count_chars(F.col("_text"), r"#*$%&|<>").alias("n_symbols"),
        count_chars(F.col("_text"), r"A-ZÀ-Þ").alias("n_upper"),
        count_chars(F.col("_text"), r"!").alias("n_exclaims"),
    )
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("n_lines", F.size("_lines").cast("long"))
    heads = F.when(F.size("_w") >= WINDOW, F.slice("_w", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    hashes = F.transform(heads, lambda w, i: F.xxhash64(w, *(F.get(F.col("_w"), i + k) for k in range(1, WINDOW))))
    df = df.select(
        "doc_id", "n_words", "n_lines", "n_symbols", "n_upper", "n_exclaims",
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.col("n_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        hashes.alias("_h"),
    )
    # only texts that repeat a window are sorted
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_p", _repeated(F.col("_s"))).drop("_h", "_s")
    gaps = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g), F.lit(0).cast("long"))
    return df.select("doc_id", "n_words", "n_lines", "n_symbols", "n_upper", "n_exclaims", "word_chars", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


Rule = list[tuple[str, str, float]]  # a conjunction of (feature, ">" or "<=", threshold)


def _condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, at in rule:
        value = F.expr(FEATURES[name])
        out = out & (value > at if op == ">" else value <= at)
    return out


def _candidates(rows: DataFrame, thresholds: DataFrame) -> list[tuple[str, str, float, int, int]]:
    """(feature, op, threshold, covered bad rows, covered good rows) of each candidate; a bounded table."""
    values = rows.select("bad", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.expr(e).alias("value")) for k, e in FEATURES.items()))).alias("f")).select("bad", "f.*")
    counted = values.join(F.broadcast(thresholds), "feature").groupBy("feature", "at").agg(
        F.sum(F.when((F.col("value") > F.col("at")) & F.col("bad"), 1).otherwise(0)).alias("p_over"),
        F.sum(F.when((F.col("value") > F.col("at")) & ~F.col("bad"), 1).otherwise(0)).alias("n_over"),
        F.sum(F.when((F.col("value") <= F.col("at")) & F.col("bad"), 1).otherwise(0)).alias("p_under"),
        F.sum(F.when((F.col("value") <= F.col("at")) & ~F.col("bad"), 1).otherwise(0)).alias("n_under"),
    )
    return sorted(x for r in counted.collect() for x in ((r.feature, ">", r["at"], r.p_over, r.n_over), (r.feature, "<=", r["at"], r.p_under, r.n_under)))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else -1.0


def learn(labelled: DataFrame, max_rules: int = 4, max_conditions: int = 3, cuts: int = 12, min_support: int = 4, min_precision: float = 0.85) -> list[Rule]:
    """labelled: the statistics, doc_id and label (1 good, 0 bad), a bounded table. Rules say what to drop."""
    rows = materialise(labelled.where("label IS NOT NULL").withColumns({"bad": F.col("label") == 0, "prune": F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0}).coalesce(4))
    shares = [(i + 0.5) / cuts for i in range(cuts)]
    marks = rows.where("bad").select(*(F.percentile_approx(F.expr(e), shares, 1000).alias(k) for k, e in FEATURES.items())).first()
    marks_good = rows.where("NOT bad").select(*(F.percentile_approx(F.expr(e), [*shares, 0.99, 0.999], 1000).alias(k) for k, e in FEATURES.items())).first()
    if any(m is None or m[0] is None for m in (marks, marks_good)):
        return []
    spark = labelled.sparkSession
    marked = {k: sorted({float(v) for m in (marks, marks_good) for v in m[k]}) for k in FEATURES}
    cut = [(k, v) for k, vs in marked.items() for v in sorted({*vs, *((a + b) / 2 for a, b in zip(vs, vs[1:], strict=False))})]
    thresholds = values(spark, cut, "feature, at")
    rules: list[Rule] = []
    left = rows
    for _ in range(max_rules):
        rule: Rule = []
        at = left.where("NOT prune")
        totals = at.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        p0, n0 = totals.p, totals.n
        while p0 >= min_support and n0 and len(rule) < max_conditions:
            found = ((_gain(p, n, p0, n0), k, op, v, p, n) for k, op, v, p, n in _candidates(at, thresholds) if p >= min_support)
            # thresholds of one feature are comparable, those of two are not: of equals the feature is fixed first, then what drops least
            best = max(found, key=lambda x: (round(x[0], 9), x[1], x[2], x[3] if x[2] == ">" else -x[3]), default=(0.0,))
            if best[0] <= 1e-9:
                break
            _, k, op, v, p0, n0 = best
            rule.append((k, op, v))
            at = at.where(_condition([(k, op, v)]))
        if not rule:
            break
        # prune: the prefix that does best on rows it was not grown on
        held = left.where("prune")
        counts = held.agg(*(f(_condition(rule[:i]) & c).alias(f"{x}{i}") for i in range(1, len(rule) + 1) for x, c, f in (("p", F.col("bad"), F.count_if), ("n", ~F.col("bad"), F.count_if)))).first()
        worth = lambda i: (counts[f"p{i}"] - counts[f"n{i}"]) / max(1, counts[f"p{i}"] + counts[f"n{i}"])
        rule = rule[: max(range(1, len(rule) + 1), key=lambda i: (worth(i), i))]
        found = left.where(_condition(rule)).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        if found.p < min_support or found.p < min_precision * (found.p + found.n):
            break
        rules.append(rule)
        left = left.where(~_condition(rule))
    return rules


def dropped_by(rules: list[Rule]) -> Column:
    """The decision list as one CASE: the text of the first rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for i, rule in reversed(list(enumerate(rules, 1))):
        name = f"{i}: " + " and ".join(f"{k} {op} {v:.6g}" for k, op, v in rule)
        out = F.when(_condition(rule), name).otherwise(out)
    return out


def labelled_sample(stats: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> DataFrame:
    """At most max_labelled labelled rows, those whose hashed ids come first; the documented bound of training."""
    few = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return stats.join(F.broadcast(few), "doc_id")


def apply(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    reason = F.when(base_failed(), "base").otherwise(dropped_by(rules))
    return stats.select("doc_id", *STATS, base_failed().alias("base_failed"), reason.alias("reason"), reason.isNull().alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000) -> DataFrame:
    """Learns from labels (doc_id, quality) and judges all docs. The statistics are written once and read for both."""
    stats = materialise(statistics(docs))
    return apply(stats, learn(labelled_sample(stats, labels, max_labelled)))
