"""From extractions to articles: combination, operations per article, results per document, patches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import paths

LISTS = ("concepts", "entities", "decisions", "action_items", "claims", "enumerations")


def field(name: str) -> Callable[[Column], Column]:
    """Takes a field of a struct, for use with transform()."""
    return lambda x: x[name]


def combine(extractions: DataFrame, key: str, order: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """A3, A5: one record a key: summaries joined in order, topics as a sorted set, lists concatenated, refs in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, "ref", "summary", "topics", *lists)))
    out = extractions.groupBy(key).agg(rows.alias("r"))
    return out.select(
        key,
        F.array_join(F.transform("r", lambda x: x["summary"]), "\n").alias("summary"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x["topics"], F.array().cast("array<string>")))))).alias("topics"),
        F.transform("r", lambda x: x["ref"]).alias("refs"),
        *(F.flatten(F.filter(F.transform("r", field(f)), F.isnotnull)).alias(f) for f in lists),
    )


def merge_groups(parts: DataFrame, key: str, owners: dict[str, str]) -> DataFrame:
    """Each field from the group that owns it."""
    return parts.groupBy(key).agg(*(F.first(F.when(F.col("part") == g, F.col(f)), ignorenulls=True).alias(f) for f, g in owners.items()))


def article_ops(targets: DataFrame) -> DataFrame:
    """A10: by article path and action the number of operations and the documents behind them; whether the path may be written."""
    grouped = targets.groupBy("path", "action").agg(F.count(F.lit(1)).alias("n_ops"), F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("docs"))
    return grouped.withColumn("valid", F.coalesce(paths.is_article(F.col("path")), F.lit(False)))


def item_results(results: DataFrame) -> DataFrame:
    """Per document the articles created and merged, the errors, and a status."""
    pick = lambda action: F.sort_array(F.collect_list(F.when((F.col("action") == action) & F.col("error").isNull(), F.col("path"))))
    out = results.groupBy("content_hash").agg(
        F.array_join(pick("create"), ",").alias("created"),
        F.array_join(pick("merge"), ",").alias("merged"),
        F.array_join(F.sort_array(F.collect_list("error")), "; ").alias("error"),
    )
    status = F.when(F.col("error") == "", "ok").when((F.col("created") == "") & (F.col("merged") == ""), "failed").otherwise("partial")
    return out.withColumn("status", status)


def duplicates(docs: DataFrame, content: Column, doc_id: str = "doc_id") -> DataFrame:
    """One row a content hash: the document kept and how many copies there are. Partial aggregation; only hashes are shuffled."""
    return docs.select(F.sha2(content, 256).alias("content_hash"), doc_id).groupBy("content_hash").agg(F.min(doc_id).alias("keep_doc_id"), F.count(F.lit(1)).alias("copies"))


# ---- patches: surgery on the lines of one article


def _level(line: str) -> int:
    bare = line.lstrip()
    return len(bare) - len(bare.lstrip("#"))


def _section_end(lines: list[str], heading: str) -> int | None:
    """Where the section under a heading ends: before the next heading of its level or a higher one. None without the heading."""
    start = next((i for i, x in enumerate(lines) if x.strip() == heading.strip()), None)
    if start is None:
        return None
    return next((i for i in range(start + 1, len(lines)) if 0 < _level(lines[i]) <= _level(heading)), len(lines))


def patched(article: str, patches: list[dict], source: str, today: str) -> str:
    """Header dates and sources brought up to date, then append_to_section and new_section; other actions do nothing."""
    lines = article.split("\n")
    close = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None) if lines[0].strip() == "---" else None
    if close:
        header, entry = lines[1:close], f"  - {source}"
        known = {x.strip() for x in header if x.startswith("  - ")}
        header = [f"updated: {today}" if x.startswith("updated:") else x for x in header]
        if not any(x.startswith("updated:") for x in header):
            header.append(f"updated: {today}")
        at = next((i for i, x in enumerate(header) if x.startswith("sources:")), None)
        if at is not None and entry.strip() not in known:
            while at + 1 < len(header) and header[at + 1].startswith("  - "):
                at += 1
            header.insert(at + 1, entry)
        lines = ["---", *header, *lines[close:]]
    for p in patches:
        text, heading = p.get("content", ""), p.get("heading", "")
        if p.get("action") == "append_to_section":
            anchor, block, fallback = p.get("section", ""), f"{text}\n", f"{p.get('section', '')}\n\n{text}"
        elif p.get("action") == "new_section":
            anchor, block, fallback = p.get("after", ""), f"\n{heading}\n\n{text}\n", f"{heading}\n\n{text}"
        else:
            continue
        end = _section_end(lines, anchor)
        if end is None:
            lines = ("\n".join(lines).rstrip() + f"\n\n{fallback}\n").split("\n")
        else:
            lines[end:end] = block.split("\n")
    return "\n".join(lines)


def apply_patches(articles: DataFrame, today: str) -> DataFrame:
    """articles: path, text, source, patches (array of structs action, section, after, heading, content). Row work in Arrow batches."""
    import pandas as pd

    def run(frames):
        for f in frames:
            new = [patched(t, [{k: v for k, v in dict(p).items() if v is not None} for p in ps], s, today) for t, ps, s in zip(f["text"], f["patches"], f["source"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "text": new})

    return articles.select("path", "text", "source", "patches").mapInPandas(run, "path string, text string")


def kept_sections(article: str, topics: set[str], budget: int) -> str:
    """All headings stay, as far as they fit; bodies are filled in by topic overlap while there is room, and come out in their old order.

    A heading costs what joins it too, a body its own characters. What stands before the first heading is a body under an empty one.
    """
    heads, bodies = [""], [[]]
    for line in article.split("\n"):
        if line.startswith("## "):
            heads.append(line)
            bodies.append([])
        else:
            bodies[-1].append(line)
    texts = ["\n".join(b) for b in bodies]
    first = 0 if bodies[0] else 1
    used, fitting = 0, []
    for i in range(first, len(heads)):
        used += len(heads[i]) + 1
        if used > budget:
            return "\n".join(heads[j] for j in fitting)
        fitting.append(i)
    wanted = {w for t in topics for w in t.lower().replace("-", " ").split()}
    telling = {i: len(wanted.intersection(heads[i].lower().replace("#", "").split())) for i in fitting}
    room, taken = budget - used, set()
    for i in sorted(fitting, key=lambda i: -telling[i]):
        if room > 0 and len(texts[i]) <= room:
            taken.add(i)
            room -= len(texts[i])
    return "\n".join(x for i in fitting for x in ([heads[i]] if i else []) + ([texts[i]] if i in taken and bodies[i] else []))


def cut_by_sections(articles: DataFrame, budget: int) -> DataFrame:
    """articles (text, topics and other columns), those longer than the budget cut by kept_sections(). Row work in Arrow batches."""

    def run(frames):
        for f in frames:
            f["text"] = [kept_sections(t, set(ts), budget) if len(t) > budget else t for t, ts in zip(f["text"], f["topics"], strict=True)]
            yield f

    return articles.mapInPandas(run, articles.schema)
