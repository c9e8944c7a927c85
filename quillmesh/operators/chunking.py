"""Chunking as native expressions: plain windows, sections of Markdown, lines of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import SPACE, content_hash, first_filled, lstrip, newlines, once, rstrip, split_lines, strip

MAX_CHARS, OVERLAP_CHARS = 1200, 120
# Extensions of Markdown and of code.
MARKDOWN = (".md", ".mdx", ".markdown")
CODE = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".kts", ".go", ".rs", ".rb", ".php", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs",
    ".swift", ".scala", ".sql", ".sh", ".bash", ".zsh", ".yaml", ".yml", ".toml", ".json", ".xml", ".html", ".css",
)
PARTS = "array<struct<text:string,line_start:int,line_end:int>>"


def check(max_chars: int, overlap: int) -> None:
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be at least 0 and less than the largest size")


def raw_windows(text: Column, max_chars: int, overlap: int) -> Column:
    """Windows as they are, with the number of line breaks ahead of each: array of (raw, ahead).

    A text is split once into steps that don't overlap, whose line breaks are counted once; a window is some of the
    steps in a row. So the work is linear in the text.
    """
    step = max_chars - overlap
    more = F.ceil((F.length(text) - max_chars) / F.lit(step)).cast("int")
    split = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("steps"), (F.greatest(more, F.lit(0)) + 1).alias("n"))

    def count(s: Column) -> Column:
        ahead = F.aggregate(s["steps"], F.array(F.lit(0)), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + newlines(x)))
        return F.struct(s["steps"].alias("steps"), s["n"].alias("n"), ahead.alias("ahead"))

    def cut(s: Column) -> Column:
        def window(k: Column) -> Column:
            parts = [F.coalesce(F.get(s["steps"], k + i), F.lit("")) for i in range(-(-max_chars // step))]
            return F.struct(F.substring(F.concat(*parts), 1, max_chars).alias("raw"), F.get(s["ahead"], k).alias("ahead"))

        return F.transform(F.sequence(F.lit(0), s["n"] - 1), window)

    return once(once(split, count), cut)


def plain_parts(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Windows of a text that is stripped already (a column of its own, not computed anew for each window). A window's
    first line is that of its start before it is stripped itself."""

    def cut(w: Column) -> Column:
        return F.struct(strip(w["raw"]).alias("text"), (w["ahead"] + 1).alias("line"))

    def place(w: Column) -> Column:
        return F.struct(w["text"].alias("text"), w["line"].cast("int").alias("line_start"), (w["line"] + newlines(w["text"])).cast("int").alias("line_end"))

    # Two steps, so that each window is stripped once.
    cuts = F.filter(F.transform(raw_windows(text, max_chars, overlap), cut), lambda w: w["text"] != "")
    return F.transform(cuts, place).cast(PARTS)


def section_parts(text: Column, line_start: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """Windows of a section, with the lines of their stripped text."""

    def cut(w: Column) -> Column:
        return F.struct(w["raw"].alias("raw"), w["ahead"].alias("ahead"), lstrip(w["raw"]).alias("rest"))

    def trim(w: Column) -> Column:
        # Lines before the first character that is kept, and those that end behind the last.
        lead = newlines(F.substring(w["raw"], F.lit(1), F.length(w["raw"]) - F.length(w["rest"])))
        return F.struct(rstrip(w["rest"]).alias("text"), (line_start + w["ahead"] + lead).alias("first"))

    def place(w: Column) -> Column:
        return F.struct(w["text"].alias("text"), w["first"].cast("int").alias("line_start"), (w["first"] + newlines(w["text"])).cast("int").alias("line_end"))

    cuts = F.filter(F.transform(F.transform(raw_windows(text, max_chars, overlap), cut), trim), lambda w: w["text"] != "")
    return F.transform(cuts, place).cast(PARTS)


# Lines of Markdown: a heading, an underline, a fence's marker and what follows it.
_HEADING = f"^ {{0,3}}#{{1,6}}(?:[{SPACE}]|$)"
_UNDERLINE = f"^ {{0,3}}(?! )[{SPACE}]*(?:=+|-+)[{SPACE}]*$"
_FENCE = r"(?s)^ {0,3}(`{3,}|~{3,})(.*)$"
# What a text without any heading or underline lacks: a line that begins, behind white space, with one of their characters.
_MAY_HAVE_HEADINGS = f"(?:^|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029])[{SPACE}]*[#=-]"
RANGES = "array<struct<a:int,b:int>>"


def blank(x: Column) -> Column:
    return ~x.rlike(f"[^{SPACE}]")


def marked_lines(lines: Column) -> Column:
    """Each line with its number and what it can be: array of (n, blank, heading, under, mark, opens, ends, titles)."""

    def mark(x: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("n"), x.alias("line"), blank(x).alias("blank"), x.rlike(_HEADING).alias("heading"), x.rlike(_UNDERLINE).alias("under"), F.regexp_extract(x, _FENCE, 1).alias("mark"), F.regexp_extract(x, _FENCE, 2).alias("rest"))

    def judge(m: Column) -> Column:
        opens = (m["mark"] != "") & ~(F.startswith(m["mark"], F.lit("`")) & F.contains(m["rest"], F.lit("`")))
        titles = ~m["blank"] & ~F.startswith(m["line"], F.lit("    ")) & ~m["heading"] & ~m["under"] & ~opens
        return F.struct(*[m[c].alias(c) for c in ("n", "blank", "heading", "under", "mark")], opens.alias("opens"), blank(m["rest"]).alias("ends"), titles.alias("titles"))

    return F.transform(F.transform(lines, mark), judge)


def markdown_ranges(marked: Column) -> Column:
    """The line ranges of sections (first, last), blank lines at their ends included, and whether there is a heading at all
    (outside fences, or a paragraph of nothing but text that is underlined): struct of (ranges, found).

    One pass carries the open fence, the section's first line, how many of its lines a new title leaves to it, and what the
    paragraph before is (0 for none, 1 for one of text only, 2 for another).
    """

    def state(open_: Column, held: Column, kept: Column, titles: Column, paragraph: Column, found: Column, ranges: Column) -> Column:
        return F.struct(
            open_.cast("string").alias("open"), held.cast("int").alias("held"), kept.cast("int").alias("kept"), titles.cast("boolean").alias("titles"), paragraph.cast("int").alias("paragraph"),
            found.cast("boolean").alias("found"), ranges.cast(RANGES).alias("ranges"),
        )

    def step(s: Column, x: Column) -> Column:
        inside, held, n = s["open"] != "", s["held"], x["n"]
        closes = inside & F.startswith(x["mark"], F.substring(s["open"], 1, 1)) & (F.length(x["mark"]) >= F.length(s["open"])) & x["ends"]
        opened = F.when(inside, F.when(closes, "").otherwise(s["open"])).when(x["opens"], x["mark"]).otherwise("")
        fenced = inside | x["opens"]
        paragraph = F.when(fenced | x["blank"], 0).when(x["titles"] & (s["paragraph"] != 2), 1).otherwise(2)
        found = s["found"] | (~inside & (x["heading"] | (x["under"] & (s["paragraph"] == 1))))

        def ended(first: Column, last: Column) -> Column:
            return F.array_append(s["ranges"], F.struct(first.cast("int").alias("a"), last.cast("int").alias("b")))

        underlined = ~inside & (held > 0) & x["under"] & s["titles"]
        begins = ~inside & x["heading"]
        first = F.when((held == 0) | begins, n).otherwise(held)
        kept = F.when(fenced | x["heading"] & ~inside | x["blank"], n - first + 1).when(held == 0, 0).otherwise(s["kept"])
        return (
            F.when((held == 0) & x["blank"], state(s["open"], held, s["kept"], F.lit(False), paragraph, found, s["ranges"]))
            .when(underlined, state(s["open"], held + s["kept"], n - held - s["kept"] + 1, F.lit(False), paragraph, found, F.when(s["kept"] > 0, ended(held, held + s["kept"] - 1)).otherwise(s["ranges"])))
            .otherwise(state(opened, first, kept, x["titles"], paragraph, found, F.when(begins & (held > 0), ended(held, n - 1)).otherwise(s["ranges"])))
        )

    none = state(F.lit(""), F.lit(0), F.lit(0), F.lit(False), F.lit(0), F.lit(False), F.array())

    def finish(s: Column) -> Column:
        last = F.struct(s["held"].alias("a"), F.lit(2**31 - 1).alias("b"))
        return F.struct(F.when(s["held"] > 0, F.array_append(s["ranges"], last)).otherwise(s["ranges"]).alias("ranges"), s["found"].alias("found"))

    return F.aggregate(marked, none, step, finish)


def markdown_parts(content: Column, max_chars: int, overlap: int) -> Column:
    """Windows of each section; null where there is no heading."""

    def sections(s: Column) -> Column:
        def solid(r: Column) -> Column:
            return F.filter(F.sequence(r["a"], F.least(r["b"], F.size(s["lines"]))), lambda k: ~F.get(s["marked"], k - 1)["blank"])

        def text(k: Column) -> Column:
            first, last = F.element_at(k, 1), F.element_at(k, -1)
            return F.struct(first.alias("line"), F.array_join(F.transform(F.sequence(first, last), lambda n: F.get(s["lines"], n - 1)), "\n").alias("text"))

        cuts = F.transform(F.filter(F.transform(s["found"]["ranges"], solid), lambda k: F.size(k) > 0), text)
        parts = F.flatten(F.transform(cuts, lambda c: section_parts(c["text"], c["line"], max_chars, overlap)))
        return F.when(s["found"]["found"], parts)

    def with_ranges(s: Column) -> Column:
        return F.struct(s["lines"].alias("lines"), s["marked"].alias("marked"), markdown_ranges(s["marked"]).alias("found"))

    lines = once(split_lines(content), lambda x: F.struct(x.alias("lines"), marked_lines(x).alias("marked")))
    return once(once(lines, with_ranges), sections)


def code_parts(content: Column, max_chars: int, overlap: int) -> Column:
    """Lines packed while they fit; blank lines before a chunk are skipped; a line that is too long is cut with overlap."""

    def state(held: Column, size: Column, out: Column) -> Column:
        return F.struct(held.cast("int").alias("held"), size.cast("int").alias("size"), out.cast(RANGES).alias("out"))

    def pack(lines: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            n, held = x["n"], s["held"]
            full = (held > 0) & (s["size"] + 1 + x["size"] > max_chars)

            def ended(out: Column, first: Column, last: Column) -> Column:
                return F.array_append(out, F.struct(first.cast("int").alias("a"), last.cast("int").alias("b")))

            before = F.when(full, ended(s["out"], held, n - 1)).otherwise(s["out"])
            return (
                F.when((held == 0) & x["blank"], s)
                .when((held > 0) & ~full, state(held, s["size"] + 1 + x["size"], s["out"]))
                .when(x["size"] > max_chars, state(F.lit(0), F.lit(0), ended(before, n, n)))
                .otherwise(state(n, x["size"], before))
            )

        sized = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), F.length(x).alias("size"), blank(x).alias("blank")))
        last = F.struct(F.lit(0).alias("a"), F.size(lines).alias("b"))
        ranges = F.aggregate(sized, state(F.lit(0), F.lit(0), F.array()), step, lambda s: F.when(s["held"] > 0, F.array_append(s["out"], F.struct(s["held"].alias("a"), last["b"].alias("b")))).otherwise(s["out"]))
        return F.struct(lines.alias("lines"), ranges.alias("ranges"))

    def texts(s: Column) -> Column:
        def text(r: Column) -> Column:
            return F.struct(F.array_join(F.transform(F.sequence(r["a"], r["b"]), lambda n: F.get(s["lines"], n - 1)), "\n").alias("text"), r["a"].alias("a"), r["b"].alias("b"))

        def part(x: Column, line_text: Column) -> Column:
            return F.struct(line_text.alias("text"), x["a"].alias("line_start"), x["b"].alias("line_end")).cast("struct<text:string,line_start:int,line_end:int>")

        def cut(x: Column) -> Column:
            # Only a line of its own can be too long.
            return F.when(F.length(x["text"]) > max_chars, F.transform(raw_windows(x["text"], max_chars, overlap), lambda w: part(x, w["raw"]))).otherwise(F.array(part(x, x["text"])))

        return F.filter(F.flatten(F.transform(F.transform(s["ranges"], text), cut)), lambda x: ~blank(x["text"]))

    return once(once(split_lines(content), pack), texts).cast(PARTS)


def kind_of(path: Column, title: Column, content: Column) -> Column:
    """markdown, code, plain, or none for blank content; ``markdown`` still depends on a heading outside fences."""
    end = F.regexp_extract(F.lower(first_filled(path, title)), r"(\.[^.]*)$", 1)
    return F.when(strip(content) == "", "none").when(end.isin(*MARKDOWN), "markdown").when(end.isin(*CODE), "code").otherwise("plain")


#: Counts up with every change of the rules below, so that documents are chunked again.
VERSION = 1


def chunker(path: Column, title: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """What made a document's chunks: rules, sizes, and the kind that its path or title names."""
    end = F.regexp_extract(F.lower(first_filled(path, title)), r"(\.[^.]*)$", 1)
    kind = F.when(end.isin(*MARKDOWN), "markdown").when(end.isin(*CODE), "code").otherwise("plain")
    return F.concat(F.lit(f"{VERSION}:{max_chars}:{overlap}:"), kind)


def chunk_documents(documents: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """All chunks of normalized documents, with ids, positions and lines."""
    check(max_chars, overlap)

    content = F.col("content")
    kinds = documents.withColumn("kind", kind_of(F.col("path"), F.col("title"), content)).filter("kind != 'none'").withColumn("body", strip(content))
    structured = F.when(F.col("kind") == "code", code_parts(content, max_chars, overlap)).when((F.col("kind") == "markdown") & content.rlike(_MAY_HAVE_HEADINGS), markdown_parts(content, max_chars, overlap))
    # Markdown without a heading outside fences is plain text.
    return number_chunks(kinds.withColumn("parts", F.coalesce(structured, plain_parts(F.col("body"), max_chars, overlap))))


def number_chunks(documents: DataFrame) -> DataFrame:
    """Rows of a ``parts`` column as chunks."""
    # Outer: else a filter on the parts' size is inferred, pushed below, and computes them again from the raw text.
    each = documents.select("*", F.posexplode_outer("parts").alias("chunk_index", "part")).filter("chunk_index is not null")
    digest = content_hash(F.col("part.text"))
    return each.select(
        F.concat("document_id", F.lit(":chunk:"), F.col("chunk_index").cast("string"), F.lit(":"), F.substring(digest, 1, 12)).alias("chunk_id"),
        "document_id", "source_id", "title", F.col("part.text").alias("text"), first_filled(F.col("canonical_url"), F.col("url")).alias("url"),
        first_filled(F.col("path"), F.col("title")).alias("path"), "chunk_index", F.col("part.line_start").alias("line_start"), F.col("part.line_end").alias("line_end"),
        "version_id", digest.alias("content_hash"), first_filled(F.col("updated_at"), F.col("date")).alias("updated_at"),
    )
