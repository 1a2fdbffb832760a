"""Scanning declared roots and deciding which files may be indexed."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreworks.functions import text as tx

MAX_FILE_BYTES = 1_000_000
_WHOLE_DIR = re.compile(r"^\*\*/([^*/?\[\]]+)/\*\*$")


@dataclass(frozen=True)
class Rules:
    """Globs of one collection; ``*`` also crosses ``/`` and case does not matter."""

    deny: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_bytes: int = MAX_FILE_BYTES
    skip_dirs: tuple[str, ...] = field(default_factory=tuple)


def glob_regex(patterns: tuple[str, ...]) -> str | None:
    """One regular expression that matches what any of the globs matches."""
    if not patterns:
        return None
    parts = [fnmatch.translate(p.replace("\\", "/")).replace(r"\Z", r"\z") for p in patterns]
    return "(?i)^(?:" + "|".join(parts) + ")"


def matches_any(rel: Column, absolute: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the relative or the absolute form of a path matches."""
    pattern = glob_regex(patterns)
    if pattern is None:
        return F.lit(False)
    return F.replace(rel, F.lit("\\"), F.lit("/")).rlike(pattern) | F.replace(absolute, F.lit("\\"), F.lit("/")).rlike(pattern)


def whole_dirs(patterns: tuple[str, ...]) -> list[str]:
    """Directory names that patterns of the exact form ``**/name/**`` exclude."""
    return [m.group(1) for p in patterns if (m := _WHOLE_DIR.match(p))]


def scan_files(spark: SparkSession, roots: list[str], with_content: bool = True) -> tuple[DataFrame, list[str]]:
    """({root, path, rel_path, size, mtime[, content]}, missing roots).

    A root that does not exist is reported, not fatal.  Without ``with_content`` only names and
    sizes are read; contents of files that fail the rules are then never opened.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001 - the public Hadoop file system API
    present, missing = [], []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        (present if path.getFileSystem(conf).exists(path) else missing).append(root.rstrip("/"))
    schema = "root string, path string, rel_path string, size long, mtime timestamp, content binary"
    out = None
    for root in present:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        clean = F.regexp_replace("path", r"^[a-z0-9]+:(//)?(?=/)", "")
        shown = files.select(
            F.lit(root).alias("root"), clean.alias("path"),
            F.substring(clean, F.lit(len(re.sub(r"^[a-z0-9]+:(//)?(?=/)", "", root)) + 2), F.char_length(clean)).alias("rel_path"),
            F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
            *(["content"] if with_content else []),
        )
        out = shown if out is None else out.unionByName(shown)
    if out is None:
        out = spark.createDataFrame([], schema if with_content else schema.rsplit(",", 1)[0])
    return out, missing


def keep_tracked(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files their project's listing names; a project without a listing keeps everything."""
    listed = listing.select("project").distinct()
    named = files.join(listing.select("project", "rel_path").distinct(), ["project", "rel_path"], "left_semi")
    return named.select(files.columns).unionByName(files.join(listed, "project", "left_anti").select(files.columns))


def admit_files(files: DataFrame, rules: Rules, listing: DataFrame | None = None) -> DataFrame:
    """Adds ``kind`` and ``verdict``: admitted, or the first rule that refuses.

    ``files`` is {project, path, rel_path, size, readable}.  The order is denied, excluded,
    untracked, wrong_type, unreadable, too_large.
    """
    tracked = F.lit(True)
    if listing is not None:
        owners = listing.select("project").distinct().withColumn("_lists", F.lit(True))
        names = listing.select("project", "rel_path").distinct().withColumn("_named", F.lit(True))
        files = files.join(owners, "project", "left").join(names, ["project", "rel_path"], "left")
        tracked = F.col("_lists").isNull() | F.col("_named").isNotNull()
    rel, absolute = F.col("rel_path"), F.col("path")
    verdict = (
        F.when(matches_any(rel, absolute, rules.deny), "denied")
        .when(matches_any(rel, absolute, rules.exclude), "excluded")
        .when(~tracked, "untracked")
        .when(F.col("kind").isNull(), "wrong_type")
        .when(~F.col("readable"), "unreadable")
        .when(F.col("size") > rules.max_bytes, "too_large")
        .otherwise("admitted")
    )
    return files.withColumn("kind", tx.content_kind(rel)).withColumn("verdict", verdict).drop("_lists", "_named")


def _top_dir(rel: Column, names: list[str]) -> Column:
    """Path of the topmost directory with one of the names, NULL when there is none."""
    if not names:
        return F.lit(None).cast("string")
    parts = F.split(rel, "/")
    at = F.array_position(
        F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*names)), F.lit(True)
    )
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/"))


def rejection_census(judged: DataFrame, rules: Rules) -> DataFrame:
    """{collection, reason, n}: refused files per rule, and directories never descended into.

    A file below a pruned directory is not counted itself; its directory is, once.
    """
    denied = _top_dir(F.col("rel_path"), whole_dirs(rules.deny))
    pruned = _top_dir(F.col("rel_path"), [*whole_dirs(rules.exclude), *rules.skip_dirs])
    marked = judged.withColumn("_d", denied).withColumn("_p", pruned)
    files = marked.where("_d IS NULL AND _p IS NULL AND verdict <> 'admitted'").groupBy(
        "collection", F.col("verdict").alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))
    outer = (
        F.when(F.col("_d").isNull() | (F.char_length("_p") < F.char_length("_d")), F.struct(F.lit("pruned_dirs").alias("reason"), F.col("_p").alias("dir")))
        .otherwise(F.struct(F.lit("denied_dirs").alias("reason"), F.col("_d").alias("dir")))
    )
    dirs = (
        marked.where("_d IS NOT NULL OR _p IS NOT NULL").select("collection", "project", outer.alias("_o"))
        .select("collection", "project", "_o.reason", "_o.dir").distinct()
        .groupBy("collection", "reason").agg(F.count(F.lit(1)).alias("n"))
    )
    return files.unionByName(dirs)


def safe_scan(files: DataFrame, rules: Rules, listing: DataFrame | None = None) -> DataFrame:
    """Admitted files with their text free of secrets: refused before reading, redacted after.

    ``files`` also carries ``text`` (or ``content``, decoded here).
    """
    from loreworks.operators.redaction import redact_column

    if "text" not in files.columns:
        files = files.withColumn("text", F.decode("content", "UTF-8")).drop("content")
    return admit_files(files, rules, listing).where("verdict = 'admitted'").withColumn("text", redact_column(F.col("text")))
