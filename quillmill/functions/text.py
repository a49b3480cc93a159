"""Text functions: Column to Column, all inside whole-stage code generation or higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = r"^#{1,6}\s"
ELLIPSIS = "…"
NOTICE = "\n\n[truncated: article exceeds the context budget]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it: inside lambdas Spark would compute it again each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def newline_normalised(text: Column) -> Column:
    """Universal newlines, before anything is hashed."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def checksum(text: Column, digits: int = 16) -> Column:
    """the head of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(newline_normalised(text), 256), 1, digits)


def flatten(text: Column, limit: Column | int) -> Column:
    """P5: white space collapsed; what is longer is cut at the last space within the limit and marked."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    head = F.substring(flat, F.lit(1), limit)
    at_space = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.contains(head, F.lit(" ")), F.concat(at_space, F.lit(ELLIPSIS))).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def split_frontmatter(text: Column) -> tuple[Column, Column]:
    """Header and body. The first line is ---, possibly indented; the closing one starts at column 0. No header gives ''."""
    pattern = r"(?s)\A[ \t]*---[ \t]*\r?\n(.*?)(?:(?<=\n)---[ \t]*(?:\r?\n|\z))"
    found = F.regexp_like(text, F.lit(pattern))
    return F.when(found, F.regexp_extract(text, pattern, 1)).otherwise(""), F.when(found, F.regexp_replace(text, pattern, "")).otherwise(text)


def first_paragraph(body: Column) -> Column:
    """P6 without the declared summary: the first block with a line that is no heading, else the first heading's text, else ''."""
    blocks = F.transform(F.split(body, "\n\n", -1), lambda b: F.array_join(F.filter(F.split(b, "\n", -1), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(HEADING)), " "))
    prose = F.get(F.filter(blocks, lambda b: b != ""), F.lit(0))
    heading = F.get(F.filter(F.split(body, "\n", -1), lambda x: F.trim(x) != ""), F.lit(0))
    return F.coalesce(prose, F.regexp_replace(heading, r"^\s*#+", ""), F.lit(""))


def summary(declared: Column, body: Column, limit: int = 200) -> Column:
    """A declared summary wins over the first paragraph."""
    own = F.when(F.trim(declared) != "", declared)
    return flatten(F.coalesce(own, first_paragraph(body)), limit)


def capped_list(items: Column, limit: int, mark: str = ", " + ELLIPSIS) -> Column:
    """Items joined by ', ' while they fit; a cut leaves whole items and the mark. The last item may use all of the limit."""
    n = F.size(items)
    first = F.slice(items, 1, limit // 2 + 2)  # each takes two characters at least, so one of these does not fit, or there are no more
    ends = F.transform(first, lambda x, i: F.aggregate(F.slice(items, F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y) + 2) - 2)
    fits = F.transform(ends, lambda e, i: e <= F.when(i < n - 1, F.lit(limit - len(mark))).otherwise(F.lit(limit)))
    stop = F.array_position(fits, F.lit(False))
    kept = F.when(stop == 0, n).otherwise((stop - 1).cast("int"))
    joined = F.array_join(F.slice(items, F.lit(1), kept), ", ")
    return F.when(stop == 0, joined).when(kept > 0, F.concat(joined, F.lit(mark))).otherwise("")


def table_keys(body: Column, limit: int = 500) -> Column:
    """Distinct back-ticked first cells of table rows, in order of appearance."""
    found = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*\|\s*`([^\s`|]+)`\s*\|"), F.lit(1))
    return capped_list(F.array_distinct(found), limit)


def catalog_line(path: Column, title: Column, about: Column, keys: Column | None = None) -> Column:
    """F2."""
    line = F.concat(F.lit("- "), path, F.lit(" — "), title, F.lit(": "), about)
    return line if keys is None else F.when(F.coalesce(keys, F.lit("")) != "", F.concat(line, F.lit(" | keys: "), keys)).otherwise(line)


def heading_for(field: Column) -> Column:
    """snake_case to Title Case; field_for is its inverse."""
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))


def field_for(heading: Column) -> Column:
    return F.lower(F.replace(heading, F.lit(" "), F.lit("_")))


def title_words(title: Column) -> Column:
    """punctuation deleted, not replaced; lower case; a set."""
    bare = F.lower(F.regexp_replace(title, r"(?U)[^a-zA-Z0-9\s]", ""))
    return F.array_distinct(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""))


def strip_fence(text: Column) -> Column:
    """a leading fence line and a trailing fence go."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\A```[^\n]*\n", ""), r"\n?```\s*\z", "")


def bounded_join(items: Column, separator: str, limit: int) -> Column:
    """joined, then cut to the first characters."""
    return F.substring(F.array_join(items, separator), 1, max(0, limit))


def truncated(text: Column, limit: int = 12_000, notice: str = NOTICE) -> Column:
    """The limit holds with the notice included."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(notice)), F.lit(notice))).otherwise(text)


def slug(text: Column, limit: int = 40) -> Column:
    """Lower case, runs of other characters to one hyphen, cut, no hyphen at either end."""
    hyphens = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    edge = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    return edge(F.substring(edge(hyphens), 1, limit))


def is_slug(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[a-z0-9][a-z0-9-]{0,39}\z"), F.lit(False))


def person_slug(name: Column) -> Column:
    """Letters and digits of any script; space, - and _ to -; squeezed."""
    kept = F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")


def wikilink_target(link: Column) -> Column:
    """F23."""
    return F.trim(F.substring_index(link, "|", 1))


def strict_frontmatter(text: Column) -> tuple[Column, Column]:
    """Only --- at the very start, alone on its line, and a closing one; the body is stripped."""
    pattern = r"(?s)\A---\n(.*?)\n---\n"
    found = F.regexp_like(text, F.lit(pattern))
    return F.when(found, F.regexp_extract(text, pattern, 1)).otherwise(""), F.trim(F.when(found, F.regexp_replace(text, pattern, "")).otherwise(text))


def document_frontmatter(text: Column) -> tuple[Column, Column]:
    """As split_frontmatter, but comments in front are skipped if a header with a field follows them."""
    bare = F.regexp_replace(text, r"(?s)\A(?:<!--.*?-->[ \t]*\r?\n(?:[ \t]*\r?\n)*)+", "")
    head, body = split_frontmatter(bare)
    own_head, own_body = split_frontmatter(text)
    revealed = head.rlike(r"(?m)^[A-Za-z_][\w-]*[ \t]*:")
    return F.when(revealed, head).otherwise(own_head), F.when(revealed, body).otherwise(own_body)


def header_field(header: Column, name: str) -> Column:
    """A scalar field of a header, quotes removed; null without it."""
    found = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    return F.when(found != "", found)


def title(text: Column, path_stem: Column) -> Column:
    """The header's title, else the first top heading, else the file's stem. A byte order mark is ignored."""
    clean = F.regexp_replace(text, "^\ufeff", "")
    head, body = split_frontmatter(clean)
    heading = F.regexp_extract(body, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    return F.coalesce(header_field(head, "title"), F.when(heading != "", heading), path_stem)


def transcript_header(body: Column) -> tuple[Column, Column, Column]:
    """F8: title, time and rest of a transcript whose head is headings, quotes and blank lines."""
    head = F.regexp_extract(body, r"\A((?:[ \t]*(?:[#>][^\n]*)?\n)*)", 1)
    name = F.regexp_extract(head, r"(?m)^#+[ \t]*(.+?)[ \t]*$", 1)
    time = F.regexp_extract(head, r"(?m)^>.*?(\d{1,2}:\d{2}(?:[ \t]*-[ \t]*\d{1,2}:\d{2})?)", 1)
    return name, time, F.substring(body, F.length(head) + 1, F.length(body))


def labelled_lines(**parts: Column) -> Column:
    """'label: value' lines of what is neither null nor empty."""
    return F.concat_ws("\n", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k.replace('_', ' ')}: "), v)) for k, v in parts.items()))


def string_list(answer: Column, most: int = 3) -> Column:
    """A model's JSON list: its strings, at most so many; whatever else it says gives none."""
    items = F.try_variant_get(F.try_parse_json(answer), "$", "array<variant>")
    strings = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: x.cast("string"))
    return F.slice(F.coalesce(strings, F.array().cast("array<string>")), 1, most)


#: Fixed value: what the body of a page made by us starts with.
STUB_MARK = "<!-- kb:stub -->"


def is_stub(page: Column, mark: str = STUB_MARK) -> Column:
    """A page with a header whose body starts with the mark."""
    head, body = split_frontmatter(page)
    return (head != "") & F.regexp_replace(body, r"^\s+", "").startswith(mark)


def existing_created(page: Column) -> Column:
    """when a page that is there was first made; null without a header that says so."""
    return header_field(split_frontmatter(page)[0], "created")


def is_transcript(header: Column) -> Column:
    """P13."""
    return F.coalesce((header_field(header, "source") == "meetings") & (header_field(header, "artifact_kind") == "vc_note_transcript"), F.lit(False))


def as_text(value: Column) -> Column:
    """F4."""
    return F.coalesce(value.cast("string"), F.lit(""))


def sorted_topics(values: Column) -> Column:
    """Topics of mixed types, as text, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(values, lambda v: ~F.is_variant_null(v)), lambda v: v.cast("string"))))


def user_message(question: Column, context: Column) -> Column:
    """F32: the question after its reference material; alone without any."""
    framed = F.concat(F.lit("<reference_material>\n"), context, F.lit("\n</reference_material>\n\n"), question)
    return F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(framed)


def extraction_size(source: Column, fields: dict[str, Column]) -> Column:
    """characters of an extraction's rendering, uncut: a line for the source and one for each field that is not empty. Lists count as JSON."""
    total = F.length(source) + len("- Source: \n")
    for name, value in fields.items():
        line = F.length(value) + len(f"- {name.replace('_', ' ').title()}: \n")
        total = total + F.when(value.isNull() | value.isin("", "[]"), 0).otherwise(line)
    return total


def head_of(content: Column, size: int = 1 << 20) -> Column:
    """The first bytes of a text, no character cut."""
    whole = F.octet_length(content) <= size
    cut = F.substring(content.cast("binary"), 1, size)
    back = F.coalesce(*(F.when(F.is_valid_utf8(F.substring(cut, F.lit(1), F.length(cut) - k)), F.substring(cut, F.lit(1), F.length(cut) - k)) for k in range(4)))
    return F.when(whole, content).otherwise(back.cast("string"))


def section_items(value: Column) -> tuple[Column, Column]:
    """the items of a section kept as JSON, none if it is blank, and an error if it is anything but a list."""
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    items = F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda v: v.cast("string"))
    return F.when(blank, F.array().cast("array<string>")).otherwise(items), F.when(~blank & items.isNull(), F.lit("not a list"))
