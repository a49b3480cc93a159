"""Answering: contexts, histories, citations, and the people named in articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import paths, text

from .tables import written


def citations(answers: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Links of an answer that lead to retrieved articles, each once, in order, spelled as retrieved.

    answers: keys and text. retrieved: path and title.
    """
    links = answers.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("pos", "link"))
    held = retrieved.select(paths.citation(F.col("path")).alias("norm"), "path", "title")
    found = links.withColumn("norm", paths.citation(F.col("link"))).groupBy(*keys, "norm").agg(F.min("pos").alias("pos")).join(held, "norm")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return found.select(*keys, rank.alias("rank"), "path", "title")


def history(messages: DataFrame) -> DataFrame:
    """a conversation as 'role: text' lines: user and assistant turns with content, without a last turn by the user."""
    kept = messages.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    rows = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    last_is_user = F.element_at("m", -1)["role"] == "user"
    m = F.when(last_is_user, F.slice("m", F.lit(1), F.size("m") - 1)).otherwise(F.col("m"))
    return rows.select("conv_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("history"))


def article_context(articles: DataFrame, key: str) -> DataFrame:
    """blocks '### title (/path)' in rank order, one text a question."""
    block = F.concat(F.lit("### "), F.col("title"), F.lit(" (/"), F.col("path"), F.lit(")\n"), text.truncated(F.col("text")))
    rows = articles.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("r"))
    return rows.select(key, F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("context"))


def titled(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """With the catalog's title, else the file's name."""
    held = catalog.select("path", F.col("title").alias("t"))
    return found.join(held, "path", "left").withColumn("title", F.coalesce("t", paths.stem(F.col("path")))).drop("t")


def alias_table(people: DataFrame) -> DataFrame:
    """Alias to canonical name, in any case; of equal aliases the later entry wins. people: ord, canonical, aliases."""
    rows = people.select("ord", "canonical", F.explode(F.concat(F.array("canonical"), "aliases")).alias("a"))
    return rows.groupBy(F.lower("a").alias("alias")).agg(F.max_by("canonical", "ord").alias("canonical"))


def mentions(articles: DataFrame, people: DataFrame) -> DataFrame:
    """A4: wikilinks that name a person: mentions, and in how many articles. articles: path, text."""
    links = articles.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("link"))
    named = links.select("path", F.lower(text.wikilink_target(F.col("link"))).alias("alias")).join(alias_table(people), "alias")
    return named.groupBy("canonical").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("path").alias("n_sources"))


def person_stubs(articles: DataFrame, people: DataFrame, existing: DataFrame, limit: int = 200) -> DataFrame:
    """A stub page for each person mentioned, except where a page not made by us stands. existing: path, is_stub.

    A summary shows the first titles only, so no more of them than it has room for are brought together; mentions are counted by title first.
    """
    links = articles.select("path", "title", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("link"))
    named = links.select("path", "title", F.lower(text.wikilink_target(F.col("link"))).alias("alias")).join(alias_table(people), "alias")
    counted = named.groupBy("canonical", "title").agg(F.count(F.lit(1)).alias("n")).transform(written)
    at = F.row_number().over(Window.partitionBy("canonical").orderBy("title"))
    shown = counted.where(F.col("title").isNotNull()).withColumn("at", at).where(F.col("at") <= limit)
    titles = shown.groupBy("canonical").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    rows = counted.groupBy("canonical").agg(F.sum("n").alias("n")).join(titles, "canonical", "left").select("canonical", "n", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))
    head = F.concat(F.lit("Person stub, "), F.col("n").cast("string"), F.when(F.col("n") == 1, " mention").otherwise(" mentions"), F.lit(" in: "))
    page = F.concat(F.lit("wiki/people/"), text.person_slug(F.col("canonical")), F.lit(".md"))
    stubs = rows.select(page.alias("path"), F.col("canonical").alias("title"), F.concat(head, text.capped_list(F.col("titles"), limit - 40)).alias("summary"))
    return stubs.join(existing.where("NOT is_stub").select("path"), "path", "left_anti")
