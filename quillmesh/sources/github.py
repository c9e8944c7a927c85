"""Repository snapshots landed as tables: entry selection, blob decoding, discovery, documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.urls import credential_like
from quillmesh.operators.chunking import CODE, MARKDOWN

MAX_FILES, MAX_BYTES = 200, 512_000
#: Fixed value: extensions of files that are taken.
TEXT = (*MARKDOWN, ".txt", ".rst", *CODE)
OBJECT_ID = "^(?:[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64})$"


def supported(path: Column) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(re.escape(x) for x in TEXT) + ")$")


COMMIT = "repo string, sha string, commit struct<tree:struct<sha:string>>"
TREE = "repo string, sha string, truncated boolean, tree array<struct<path:string,type:string,sha:string,size:long>>"


def snapshot_entries(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """Entries (repo, commit_sha, path, type, sha, size) of landed commits and their trees (COMMIT, TREE).

    A repository whose commit or tree has no sound object id, or whose tree is missing or truncated, stops the job: a
    snapshot with a part of a tree would delete the rest.
    """
    sound = lambda c: F.coalesce(c.rlike(OBJECT_ID), F.lit(False))
    heads = commits.select("repo", F.col("sha").alias("commit_sha"), F.col("commit.tree.sha").alias("tree_sha"))
    joined = heads.join(trees.select("repo", F.col("sha").alias("tree_sha"), "truncated", "tree"), ["repo", "tree_sha"], "left")
    why = (
        F.when(~sound(F.col("commit_sha")), "commit sha was invalid").when(~sound(F.col("tree_sha")), "tree sha was invalid")
        .when(F.coalesce("truncated", F.lit(False)), "tree was truncated").when(F.col("tree").isNull(), "tree was missing")
    )
    checked = joined.withColumn("tree", F.when(why.isNull(), F.col("tree")).otherwise(F.raise_error(F.concat_ws(": ", "repo", why)).cast(joined.schema["tree"].dataType)))
    return checked.select("repo", "commit_sha", F.explode("tree").alias("e")).select("repo", "commit_sha", "e.*")


def select_entries(tree: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Entries (repo, path, type, sha, size) with a verdict each: keep, skip (silently) or incomplete.

    Checked in order: path, blob, object id, extension, credentials, size, and the repository's cap by path.
    """
    path, size = F.col("path"), F.col("size")
    verdict = (
        F.when(path.isNull() | path.rlike(r"[\x00-\x1f\x7f]"), "incomplete").when(F.coalesce("type", F.lit("")) != "blob", "skip")
        .when(~F.coalesce(F.col("sha").rlike(OBJECT_ID), F.lit(False)), "incomplete").when(~supported(path), "skip").when(credential_like(path), "incomplete")
        .when(size.isNull() | (size < 0) | (size > max_bytes), "incomplete").otherwise("keep")
    )
    judged = tree.withColumn("verdict", verdict)
    # Only kept entries are numbered together; the others are spread.
    w = Window.partitionBy("repo", "verdict", F.when(F.col("verdict") != "keep", F.pmod(F.hash("path"), F.lit(256)))).orderBy("path", "sha")
    over = (F.col("verdict") == "keep") & (F.row_number().over(w) > max_files)
    return judged.withColumn("verdict", F.when(over, "incomplete").otherwise(F.col("verdict")))


def completeness(judged: DataFrame) -> DataFrame:
    """Per snapshot whether nothing was left out that ought to be there, and how many entries it keeps."""
    return judged.groupBy("repo").agg(F.bool_and(F.col("verdict") != "incomplete").alias("complete"), F.count_if(F.col("verdict") == "keep").alias("n_files"))


def decode_blobs(blobs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Blobs (encoding, content, size, tree_size) with their text, or null and why: size mismatch fails, others are skipped."""
    compact = F.regexp_replace("content", r"\s", "")
    raw = F.when(F.col("encoding") == "base64", F.try_to_binary(compact, F.lit("base64"))).when(F.col("encoding").isin("utf-8", "text", ""), F.encode("content", "UTF-8"))
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    why = (
        F.when(F.col("size") != F.col("tree_size"), "size mismatch").when(F.col("size") > max_bytes, "too large").when(F.col("raw").isNull(), "undecodable")
        .when(F.length("raw") != F.col("size"), "size mismatch").when(F.col("text").isNull(), "not utf-8").when(F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "binary")
    )
    return blobs.withColumn("raw", raw).withColumn("text", text).withColumn("error", why).withColumn("text", F.when(F.col("error").isNull(), F.col("text"))).drop("raw")


def discover(public: DataFrame, owned: DataFrame, owner: str) -> DataFrame:
    """Repositories of an owner from both lists, the first of each name without regard to case."""
    both = public.withColumn("list", F.lit(0)).unionByName(owned.withColumn("list", F.lit(1))).filter(F.lower("owner") == owner.lower())
    w = Window.partitionBy(F.lower("owner"), F.lower("name")).orderBy("list", "position")
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def quote_path(path: Column) -> Column:
    """Percent-quoted but for slashes."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def documents(entries: DataFrame) -> DataFrame:
    """Selected entries (owner, name, commit_sha, path, sha, text) as connector rows."""
    key = F.concat(F.lit("github:"), F.lower("owner"), F.lit("/"), F.lower("name"), F.lit(":"), F.col("path"))
    url = F.concat(F.lit("https://github.com/"), F.col("owner"), F.lit("/"), F.col("name"), F.lit("/blob/"), F.col("commit_sha"), F.lit("/"), quote_path(F.col("path")))
    return entries.select(
        key.alias("id"), key.alias("external_id"), F.concat_ws("/", "owner", "name", "path").alias("title"), F.col("text").alias("content"), url.alias("url"),
        url.alias("canonical_url"), F.lit("GitHub").alias("platform"), "path", F.col("sha").alias("updated_at"), F.col("sha").alias("version_id"),
    )


_OWNER, _REPO = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]{0,38}"), re.compile(r"[A-Za-z0-9._-]+")


def parse_spec(value: str) -> tuple[str, str, str]:
    """owner/repo or owner/repo@ref; ValueError for anything else."""
    name, _, ref = value.strip().partition("@")
    owner, slash, repo = name.partition("/")
    bad_ref = "@" in value and (not ref or ref.startswith(("/", "-", ".")) or ref.endswith(("/", ".", ".lock")) or ".." in ref or "//" in ref or "@{" in ref or set(ref) & set("\\ ~^:?*[]") or any(ord(c) < 33 or ord(c) == 127 for c in ref))
    if not slash or not _OWNER.fullmatch(owner) or not _REPO.fullmatch(repo) or repo in (".", "..") or bad_ref:
        raise ValueError("a repository is given as owner/repo or owner/repo@ref")
    return owner, repo, ref


def unique_specs(values: list[str]) -> list[tuple[str, str, str]]:
    specs = [parse_spec(v) for v in values]
    if len({(o.lower(), r.lower()) for o, r, _ in specs}) != len(specs):
        raise ValueError("a repository is named twice")
    return specs
