"""Readers and writers: directories of text, JSON and HTML, JSON lines, CSV, Parquet."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = ("txt", "json", "html", "htm")
MAX_BYTES = 2 << 20
READERS = {"jsonl": "json", "ndjson": "json", "json": "json", "csv": "csv", "parquet": "parquet"}


def discover(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """identifier, extension, size, content, error of every file below folder, failures as rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(~ext.isin(*EXTENSIONS), "EXTENSION").when(F.col("length") > max_bytes, "TOO_LARGE").when(F.col("length") == 0, "EMPTY")
    rows = files.select(F.col("path").alias("identifier"), ext.alias("extension"), F.col("length").alias("size"), "content", error.alias("error"))
    return rows.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))


def decode(rows: DataFrame) -> DataFrame:
    """Adds text: UTF-16 and UTF-32 by their marks, else UTF-8; bad bytes or NUL become an error."""

    def run(batches):
        import codecs

        marks = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))

        def one(data):
            if data is None:
                return None, None
            kind = next((k for m, k in marks if data.startswith(m)), "utf-8-sig")
            try:
                text = data.decode(kind)
            except UnicodeDecodeError:
                return None, "ENCODING"
            return (None, "NUL") if "\0" in text else (text, None)

        for frame in batches:
            got = [one(None if x is None else bytes(x)) for x in frame["content"]]
            frame["text"] = [g[0] for g in got]
            frame["error"] = [e if e is not None else g[1] for e, g in zip(frame["error"], got, strict=True)]
            yield frame.drop(columns="content")

    return rows.mapInPandas(run, "identifier string, extension string, size long, error string, text string")


def json_documents(rows: DataFrame, column: str, content_keys: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Adds content (the first of content_keys present) and n_unknown (keys that are not allowed)."""
    content = F.coalesce(*(F.get_json_object(column, f"$.{k}") for k in content_keys))
    unknown = F.size(F.array_except(F.json_object_keys(column), F.array(*map(F.lit, allowed))))
    return rows.withColumn("content", content).withColumn("n_unknown", unknown.cast("long"))


def looks_like_json(text: Column) -> Column:
    return text.rlike(r"^\s*[\[{]")


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"(?i)<(?:!doctype html|html|body|p|div|h1)\b")


def safe_identifier(path: Column) -> Column:
    """A relative path with single slashes; null if empty, absolute, climbing, with a drive or control characters, or over 512 long."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (plain == "") | (F.length(plain) > 512) | plain.startswith("/") | plain.rlike(r"(^|/)\.\.(/|$)") | plain.rlike(r"^[A-Za-z]:") | plain.rlike(r"[\x00-\x1f]")
    return F.when(~bad, F.regexp_replace(plain, "/+", "/"))


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: jsonl, ndjson, json, csv, parquet."""
    kind = READERS[path.rstrip("/").rsplit(".", 1)[-1].lower()]
    reader = spark.read.format(kind)
    if schema:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Keys sorted, nulls kept; the job's commit makes it whole or absent."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Columns sorted, nested values as JSON."""
    cells = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in sorted(df.dtypes)]
    df.select(*cells).write.option("header", True).option("escape", '"').csv(path)


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """file_number, case_number, matches, payload of case-NNNN.json files."""
    raw = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("payload"))
    number = F.regexp_extract("file", r"case-(\d{4})\.json$", 1).try_cast("int")
    own = F.get_json_object("payload", "$.case_number").try_cast("int")
    return raw.select(number.alias("file_number"), own.alias("case_number"), number.eqNullSafe(own).alias("matches"), "payload")


def with_metadata(metadata: dict) -> dict:
    """The sidecar of a data set: metadata and the digest of its canonical JSON."""
    text = json.dumps(metadata, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return {"metadata": metadata, "metadata_sha256": hashlib.sha256(text.encode()).hexdigest()}


def check_metadata(sidecar: dict) -> bool:
    return with_metadata(sidecar["metadata"])["metadata_sha256"] == sidecar.get("metadata_sha256")


def envelope_checks(records: DataFrame, key: str, expected: int) -> DataFrame:
    """n, duplicates, status (FULL when all expected keys are there once), records_sha256 (order does not matter)."""
    line = F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256)
    rows = records.select(F.col(key).alias("_k"), F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(38,0)").alias("_h"))
    sums = rows.groupBy("_k").agg(F.count("*").alias("c"), F.sum("_h").alias("h")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 1).alias("duplicates"), F.sum("h").alias("h"))
    full = (F.col("n") == expected) & (F.col("duplicates") == 0)
    return sums.select("n", "duplicates", F.when(full, "FULL").otherwise("PARTIAL").alias("status"), F.sha2(F.col("h").cast("string"), 256).alias("records_sha256"))


def markdown_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, md: a small table's rows in order of the first column. Callers pass aggregates."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    listed = F.array_sort(F.collect_list(F.struct(F.col(columns[0]).alias("k"), line.alias("line"))))
    return rows.agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("md"))


def duplicate_flags(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("duplicated", F.count("*").over(Window.partitionBy(key)) > 1)
