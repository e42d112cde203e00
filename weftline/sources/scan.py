"""Scans of files: source trees by rules, saved states, JSON lines."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "version int, source_hash decimal(20,0), segments array<struct<id:string,source:string,source_hash:decimal(20,0),context_hash:decimal(20,0),translation:string,glossary_snapshot:map<string,string>,translated_at:timestamp,issues:array<string>>>"


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: * and ? stop at separators, ** doesn't, braces are alternatives."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def source_files(spark: SparkSession, root: str, rules: list[dict] | None = None) -> DataFrame:
    """(path, rule, content) of the files under root that the first matching rule {path, pattern, exclude} takes; **/*.md without rules. Paths are relative to root; excluded files and files no rule takes are left out."""
    rules = rules or [{"path": "", "pattern": "**/*.md"}]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.replace("file://", "").rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + re.escape(base) + "/", "")
    named = files.select(path.alias("path"), "content")
    rule: Column = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules))):
        head = r.get("path", "").strip("/")
        full = f"{head}/{r['pattern']}" if head else r["pattern"]
        hit = F.col("path").rlike(glob_regex(full))
        for e in r.get("exclude", []):
            hit = hit & ~F.col("path").rlike(glob_regex(f"{head}/{e}" if head else e))
        rule = F.when(hit, k).otherwise(rule)
    return named.withColumn("rule", rule).filter("rule is not null").select("path", "rule", "content")


def output_path(path: Column, template: str | None = None) -> Column:
    """Where a file's translation goes: {dir}, {stem}, {ext} and {path} of a template, or stem.ko.ext beside it."""
    directory = F.regexp_extract(path, r"^(.*/)?", 0)
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    parts = {"dir": directory, "stem": stem, "ext": ext, "path": path}
    out = [parts[p] if p in parts else F.lit(p) for p in re.split(r"\{(dir|stem|ext|path)\}", template or "{dir}{stem}.ko{ext}") if p]
    return F.concat(*out)


def states(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a saved segment of the state files; hashes above 2^63 stay whole."""
    df = spark.read.schema(STATE).option("multiLine", "true").json(paths).withColumn("file", F.input_file_name())
    return df.select("file", "version", F.explode("segments").alias("s")).select("file", "version", "s.*")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines files, blank lines skipped; a malformed line is an error. bucket is the middle part of a name like items.<bucket>.jsonl."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return df.withColumn("bucket", F.nullif(F.regexp_extract(F.input_file_name(), r"\.([^./]+)\.jsonl$", 1), F.lit("")))


def write_json_lines(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("error")
    (writer.partitionBy(*by) if by else writer).json(path)


def state_path(path: Column | str, directory: str | None = None, suffix: str = ".state.json") -> Column:
    """The file that holds a source's state: beside it, or at the same place under `directory`; an absolute path keeps it beside. The suffix follows the whole name, so sources that differ in their extension have states of their own."""
    p = F.col(path) if isinstance(path, str) else path
    beside = F.concat(p, F.lit(suffix))
    if directory is None:
        return beside
    return F.when(p.startswith("/"), beside).otherwise(F.concat(F.lit(directory.rstrip("/") + "/"), F.regexp_replace(p, r"^(?:\./)+", ""), F.lit(suffix)))


def publish(df: DataFrame, target: str, kind: str = "json") -> None:
    """Write a folder whole: its files appear under `target` by one rename when all are written, in place of what stood there; a job that dies before leaves the old ones."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    draft, old = f"{target}.{uuid.uuid4().hex}", f"{target}.{uuid.uuid4().hex}.old"
    df.write.format(kind).save(draft)
    fs = at(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.exists(at(target))
    if held:
        fs.rename(at(target), at(old))
    if not fs.rename(at(draft), at(target)):
        raise OSError(f"{target} could not be written")
    if held:
        fs.delete(at(old), True)


def write_states(rows: DataFrame, target: str, path: str, place: str) -> None:
    """Save segment states: a line a segment in the order of path and place, large files spread over several parts, published whole."""
    ordered = rows.withColumnRenamed(place, "place").repartitionByRange(path, "place").sortWithinPartitions(path, "place")
    publish(ordered, target)


def read_written_states(spark: SparkSession, target: str) -> DataFrame:
    """What write_states saved; hashes above 2^63 stay whole."""
    return spark.read.schema("path string, seg_id string, feed_id bigint, source_hash decimal(20,0), context_hash decimal(20,0), translation string, translated_at timestamp, place bigint").json(target)


def toml_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, section, term, kind, translation, note, excepts) of glossary and term-base files: tables [terms.X] and [whole.X], and the lists of [rejected], whose entries have no translation. A malformed file is an error."""
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["value"]):
                data = tomllib.loads(text)
                for section in ("terms", "whole"):
                    for term, e in sorted(data.get(section, {}).items()):
                        e = e if isinstance(e, dict) else {"translation": e}
                        rows.append((file, section, term, e.get("kind"), e.get("translation"), e.get("note"), list(e.get("except", []))))
                for section, names in sorted(data.get("rejected", {}).items()):
                    rows += [(file, f"rejected {section}", n, None, None, None, []) for n in sorted(names)]
            yield pd.DataFrame(rows, columns=["file", "section", "term", "kind", "translation", "note", "excepts"])

    return texts.mapInPandas(run, "file string, section string, term string, kind string, translation string, note string, excepts array<string>")


def revision_files(spark: SparkSession, repository: str, revision: str, paths: list[str]) -> DataFrame:
    """(path, content) of files as a git revision holds them; content is null for a path it lacks. Executors must see the repository."""
    schema = "path string, content string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for batch in batches:
            found = [subprocess.run(["git", "-C", repository, "show", f"{revision}:{p}"], capture_output=True) for p in batch["path"]]
            yield pd.DataFrame({"path": batch["path"], "content": [f.stdout.decode("utf-8", "replace") if f.returncode == 0 else None for f in found]})

    if not paths:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 64)).mapInPandas(run, schema)


def revision_states(spark: SparkSession, repository: str, revision: str, paths: list[str]) -> DataFrame:
    """(path, id, source_hash, translation) of the segments that state files hold at a revision; files that the revision lacks give none."""
    files = revision_files(spark, repository, revision, paths).filter("content is not null")
    return files.select("path", F.explode(F.from_json("content", STATE)["segments"]).alias("s")).select("path", "s.id", "s.source_hash", "s.translation")


def patched_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, target): the paths that each unified diff touches, once each."""
    from weftline.functions.text import patch_targets

    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f, t) for f, v in zip(batch["file"], batch["value"]) for t in patch_targets(v)], columns=["file", "target"])

    return texts.mapInPandas(run, "file string, target string")
