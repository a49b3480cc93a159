"""The task queue, sessions and the ledger of model calls, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prices per million tokens (model, input, output), and the families that stand for them.
PRICES = (
    ("claude-opus-4-6", 5.0, 25.0),
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("claude-haiku-4-5", 1.0, 5.0),
)
TERMINAL = ("succeeded", "failed", "cancelled")


def page(tasks: DataFrame, status: str | None, query: str, columns: list[str], order: Column, tie: Column, number: int, size: int, search: list[str]) -> DataFrame:
    """One page of the filtered tasks with the total. LIKE folds case, and % and _ in the query stay wild."""
    hit = F.lit(False)
    for c in search:
        hit = hit | F.col(c).ilike(f"%{query}%")
    kept = tasks.where(hit if status is None else (F.col("status") == status) & hit)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy(order, tie).offset((number - 1) * size).limit(size).select(*columns).crossJoin(F.broadcast(total))


def claim_next(tasks: DataFrame, queue: str, created: str, key: str) -> DataFrame:
    """The oldest pending task of each queue; an aggregate, so nothing is sorted."""
    return tasks.where("status = 'pending'").groupBy(queue).agg(F.min(F.struct(created, key)).alias("m")).select(queue, F.col(f"m.{key}").alias(key))


def recover_expired(tasks: DataFrame, now: Column) -> DataFrame:
    """Running tasks whose lease has run out become pending again."""
    out = (F.col("status") == "running") & (F.col("lease") > 0) & (F.col("lease") <= now)
    return tasks.withColumn("new_status", F.when(out, "pending").otherwise(F.col("status")))


def delete_terminal(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """P25: what remains; only finished tasks can go."""
    return tasks.join(asked.join(tasks.where(F.col("status").isin(*TERMINAL)).select("id"), "id", "left_semi"), "id", "left_anti")


def resolve_prices(models: DataFrame, overrides: list[tuple[str, float, float]] = (), prices: tuple = PRICES) -> DataFrame:
    """Each model's price: override exact, override part, table exact, table family prefix, family name; else 0 and not priced.

    The tables hold a handful of fixed rows and become one CASE, first match first.
    """
    m, low = F.col("model"), F.lower("model")
    rules = [(m == k, i, o) for k, i, o in overrides] + [(F.contains(low, F.lit(k.lower())), i, o) for k, i, o in overrides]
    rules += [(m == k, i, o) for k, i, o in prices] + [(m.startswith(k.rsplit("-", 1)[0]), i, o) for k, i, o in prices]
    rules += [(F.contains(low, F.lit(k.split("-")[1])), i, o) for k, i, o in prices]
    price = F.lit(None).cast("struct<i:double,o:double>")
    for test, i, o in reversed(rules):
        price = F.when(test, F.struct(F.lit(i).alias("i"), F.lit(o).alias("o"))).otherwise(price)
    return models.withColumn("_p", price).withColumns({"input": F.coalesce("_p.i", F.lit(0.0)), "output": F.coalesce("_p.o", F.lit(0.0)), "priced": F.col("_p").isNotNull()}).drop("_p")


def cost(prompt: Column, cached: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """cached prompt tokens at a tenth."""
    return ((prompt - cached) * price_in + cached * price_in * 0.1 + completion * price_out) / 1e6


def ledger(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and cost; sums only, so each task adds up its own first. calls: by, prompt, cached, completion, input, output."""
    c = cost(F.col("prompt"), F.col("cached"), F.col("completion"), F.col("input"), F.col("output"))
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.round(F.sum(c), 2).alias("cost"))


def deltas(counters: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """What a cumulative counter gained since the row before."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(key).orderBy(order))
    return counters.withColumn("delta", F.col(value) - before)


def bucket(at: Column, now: Column) -> Column:
    """By calendar day relative to now."""
    days = F.datediff(F.to_date(now), F.to_date(at))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "last7days").when(days <= 30, "last30days").otherwise("older")


def longest_runs(rows: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """The longest run of rows that hit, by key; 0 for keys with none. Gaps and islands: misses number the islands."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = rows.select(key, hit.alias("hit"), F.sum(F.when(~hit, 1).otherwise(0)).over(by).alias("island"))
    runs = marked.groupBy(key, "island").agg(F.count_if("hit").alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest_run"))


def log_lines(operations: DataFrame) -> DataFrame:
    """A line for each operation of a run: '[op] target: prompt+completion tokens, $cost', four digits; an alert where it failed. operations: op, target, prompt, completion, cost, error."""
    tokens = F.concat(F.col("prompt").cast("string"), F.lit("+"), F.col("completion").cast("string"), F.lit(" tokens"))
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("ALERT "), F.col("error"))).otherwise(F.concat(tokens, F.lit(", $"), F.format_string("%.4f", F.col("cost"))))
    return operations.select("op", "target", F.concat(F.lit("["), "op", F.lit("] "), "target", F.lit(": "), said).alias("line"))
