"""Wiki pages from evidence: citations, backlinks, sections, Markdown, and checks of synthesized text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.redact import prompt
from quillmesh.functions.text import first_filled, location, markers, slug, snippet

# Abbreviations whose dots end no sentence; the parts behind a dot that belong to the name before it; names
# with dots, files whose names begin with one, and initials.
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.")
NAME_PARTS = {"ai", "app", "com", "dev", "env", "go", "io", "js", "json", "local", "md", "net", "org", "py", "rs", "toml", "ts", "txt", "yaml", "yml"}
DOTTED_NAME = re.compile(r"\b[A-Za-z0-9_-]+(?:\.[a-z0-9_-]+)+")
DOT_FILE = re.compile(r"(?:^|(?<=[\s/]))\.[A-Za-z0-9_-]+(?:\.[a-z0-9_-]+)*")
INITIALS = re.compile(r"\b(?:[A-Za-z]\.){2,}")

_ABBREVIATION = re.compile("|".join(map(re.escape, ABBREVIATIONS)), re.IGNORECASE)
_BULLET = re.compile(r"(?:[-*]\s+)?(?:\d+[.)]\s+)?")
_SAYS = re.compile(r"[A-Za-z0-9가-힣]")
#: What the scanner stops at: a run of markers with the space behind it, or a mark that may end a sentence.
_STOP = re.compile(r"(?P<cited>\[C\d+\](?:\s*\[C\d+\])*)(?P<gap>\s*)|[.!?]")
_CITED_AFTER = re.compile(r"\s+(?P<cited>\[C\d+\](?:\s*\[C\d+\])*)\s*")


def citations(evidence: DataFrame, order: str = "rank") -> DataFrame:
    """Evidence (bounded by top-k) with a marker C1, C2, … in rank order."""
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order))
    return evidence.withColumn("n", at).withColumn("marker", F.concat(F.lit("C"), F.col("n").cast("string")))


def backlinks(evidence: DataFrame) -> DataFrame:
    """One row a document, in order of its first evidence, with all its chunk ids in rank order."""
    first = {c: F.min_by(c, "rank").alias(c) for c in ("source_id", "source_type", "title", "url", "path")}
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    return evidence.groupBy("document_id").agg(*first.values(), F.min("rank").alias("first_rank"), ids.alias("chunk_ids"))


def section_valid(content: Column, listed: Column, known: Column) -> Column:
    """A section's text cites something, only what is known, and exactly what it lists."""
    found = F.array_sort(F.array_distinct(markers(content)))
    return (F.size(found) > 0) & (F.size(F.array_except(found, known)) == 0) & (found == F.array_sort(F.array_distinct(listed)))


def markers_valid(content: Column, known: Column, require_all: bool) -> Column:
    found = F.array_distinct(markers(content))
    good = (F.size(found) > 0) & (F.size(F.array_except(found, known)) == 0)
    return good & (F.size(F.array_except(known, found)) == 0) if require_all else good


def inner_dots(line: str) -> set[int]:
    """Places of dots that end no sentence: in abbreviations, initials, and names up to their last known part."""
    held = {m.start() + k for p in (_ABBREVIATION, INITIALS) for m in p.finditer(line) for k, c in enumerate(m[0]) if c == "."}
    for m in (*DOT_FILE.finditer(line), *DOTTED_NAME.finditer(line)):
        at = m.start() + m[0].index(".")
        for part in m[0].split(".")[1:]:
            if part.lower() not in NAME_PARTS:
                break
            held.add(at)
            at += 1 + len(part)
    return held


def line_sentences(line: str) -> Iterator[str]:
    """Sentences of one line. A mark ends one unless a digit follows or its dot is an inner one, and takes the citations
    behind it along; citations with more text behind them end one too."""
    inner, begin, at = inner_dots(line), 0, 0
    while stop := _STOP.search(line, at):
        at = stop.end()
        if stop["cited"]:
            if stop["gap"] and at < len(line):
                yield line[begin : stop.start("gap")]
                begin = at
        elif stop.start() not in inner:
            if cited := _CITED_AFTER.match(line, at):
                yield f"{line[begin : stop.start()]} {cited['cited']}{stop[0]}"
                begin = at = cited.end()
            elif not line[at : at + 1].isdigit():
                yield line[begin:at]
                begin = at
    yield line[begin:]


def sentences(text: str) -> list[str]:
    """Sentences that say something, outside fenced blocks and headings, without bullets and numbers of lists."""
    out, fenced = [], False
    for line in map(str.strip, (text or "").splitlines()):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and not line.startswith("#"):
            found = map(str.strip, line_sentences(line[_BULLET.match(line).end() :]))
            out += [x for x in found if _SAYS.search(x)]
    return out


def substantive_sentences(text: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(sentences)

    return run(text)


def every_sentence_cited(content: Column, known: Column | None = None) -> Column:
    """Whether each sentence cites something, and, where ``known`` is given, nothing but what is known."""

    def cited(found: Column) -> Column:
        return (F.size(found) > 0) & (F.lit(True) if known is None else F.size(F.array_except(found, known)) == 0)

    return F.forall(F.transform(substantive_sentences(content), markers), cited)


def page(evidence: DataFrame, topic: str, min_results: int = 1) -> DataFrame:
    """One row: topic, status, title, markdown, used_chunks, from bounded evidence with ranks."""
    cited = citations(evidence)
    where = location(F.col("path"), F.col("url"), F.col("document_id"), F.col("line_start"), F.col("line_end"))
    entry = F.struct(
        "n", "chunk_id", F.concat(F.lit("- "), snippet(first_filled(F.col("text"), F.col("preview"))), F.lit(" ["), F.col("marker"), F.lit("]")).alias("overview"),
        F.concat(F.lit("- ["), F.col("marker"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("source_id"), F.lit(") "), where, F.lit(" `"), F.col("chunk_id"), F.lit("`")).alias("citation"),
        (first_filled(F.col("text"), F.col("preview")) != "").alias("said"),
    )
    left = cited.agg(F.count("*").alias("n_evidence"), F.array_sort(F.collect_list(entry)).alias("entries"))
    link = F.struct(
        "first_rank", F.concat(F.lit("- "), F.col("title"), F.lit(" ("), first_filled(F.col("source_type"), F.col("source_id")), F.lit(")")).alias("related"),
        F.concat(F.lit("- "), F.col("title"), F.lit(" -> "), first_filled(F.col("url"), F.col("path"), F.col("document_id"))).alias("backlink"),
    )
    right = backlinks(evidence).agg(F.array_sort(F.collect_list(link)).alias("links"))

    def lines(rows: str, field: str) -> Column:
        return F.array_join(F.transform(rows, lambda r: r[field]), "\n")

    overview = F.array_join(F.transform(F.filter("entries", lambda r: r["said"]), lambda r: r["overview"]), "\n")
    overview = F.when(overview == "", f"No narrative evidence was available for {topic}.").otherwise(overview)
    text = F.concat_ws(
        "\n", F.lit(f"# {topic} Wiki\n"), F.lit("Generated from active chunks with citation markers.\n"), F.lit("## Overview\n"), overview, F.lit("\n## Related Sources\n"),
        lines("links", "related"), F.lit("\n## Backlinks\n"), lines("links", "backlink"), F.lit("\n## Citations\n"), lines("entries", "citation"), F.lit(""),
    )
    enough = F.col("n_evidence") >= min_results
    return left.crossJoin(right).select(
        F.lit(topic).alias("topic"), F.when(enough, "generated").otherwise("insufficient_evidence").alias("status"), F.lit(f"{topic} Wiki").alias("title"),
        F.when(enough, text).otherwise("Insufficient evidence in indexed context to generate a wiki page.").alias("markdown"),
        F.when(enough, F.array_join(F.transform("entries", lambda r: r["chunk_id"]), ",")).otherwise("").alias("used_chunks"),
    )


#: What a synthesizer is asked to give back.
CONTRACT = {
    "title": "Short page title.",
    "sections": [{"heading": "Section heading", "content": "Section prose with citation markers such as [C1].", "citation_markers": ["C1"]}],
    "markdown": "Full Markdown page using the same citation markers.",
}


def prompt_payload(cited: DataFrame, topic: str, instructions: str, links: DataFrame, max_chars: int = 1200) -> DataFrame:
    """One row: the payload of a synthesis as JSON, everything redacted and evidence cut to ``max_chars``.

    ``cited`` is bounded evidence with markers (see ``citations``), ``links`` its backlinks.
    """

    def clean(name: str) -> Column:
        return prompt(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(name)

    fields = ("marker", "chunk_id", "document_id", "source_id", "title", "url", "path")
    row = F.struct("n", *[clean(c) for c in fields], "line_start", "line_end", snippet(prompt(F.coalesce("text", F.lit(""))), max_chars).alias("text"))
    left = cited.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    right = links.agg(F.array_sort(F.collect_list(F.struct("first_rank", *[clean(c) for c in ("document_id", "source_id", "title", "url", "path")], "chunk_ids"))).alias("links"))

    def without(x: Column, first: str) -> Column:
        return F.transform(x, lambda r: r.dropFields(first))

    evidence = without(F.col("rows"), "n")
    made = F.struct(
        prompt(F.lit(topic)).alias("topic"), prompt(F.lit(instructions)).alias("instructions"),
        F.from_json(F.lit(json.dumps(CONTRACT)), "title string, sections array<struct<heading:string,content:string,citation_markers:array<string>>>, markdown string").alias("output_contract"),
        evidence.alias("evidence"), F.transform(evidence, lambda r: r.dropFields("text")).alias("citations"), without(F.col("links"), "first_rank").alias("backlinks"),
    )
    return left.crossJoin(right).select(F.to_json(made).alias("payload"))


def results_markdown(results: DataFrame, query: str) -> DataFrame:
    """One row: bounded results (rank, title, url, platform, date, score, text) as a Markdown list."""
    line = F.concat(
        F.lit("## "), F.col("rank").cast("string"), F.lit(". ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")\n**Platform**: "), F.col("platform"), F.lit(" | **Date**: "), F.col("date"),
        F.lit("\n**Relevance**: "), F.format_string("%.3f", "score"), F.lit("\n**Preview**: "), F.col("text"), F.lit("\n"),
    )
    one = results.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    text = F.concat(F.lit(f"# 🔍 Search results: '{query}'\n\nTotal "), F.col("n").cast("string"), F.lit(" documents found\n\n"), body)
    return one.select(F.when(F.col("n") == 0, f"No results found for '{query}'").otherwise(text).alias("markdown"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages as files: each page's Markdown as text under its slug's partition, and all rows as JSON."""
    named = pages.withColumn("slug", slug(F.col("title")))
    named.select("slug", F.col("markdown").alias("value")).write.partitionBy("slug").mode("overwrite").text(f"{folder}/markdown")
    named.write.mode("overwrite").json(f"{folder}/json")
