"""Inventories of runs, manifests and stored files: what is there against what ought to be."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Findings of a run, the gravest first.
SEVERITY = {"UNEXPECTED_CASES": "BLOCK", "DIGEST_MISMATCH": "BLOCK", "DUPLICATE_CASES": "BLOCK", "REPORT_DISAGREES": "BLOCK", "MISSING_CASES": "WARN", "FAILED_CASES": "WARN", "NOT_REPORTED": "WARN"}


def run_inventory(cases: DataFrame, manifest: DataFrame, reported: DataFrame) -> DataFrame:
    """One row per run of cases or reported: expected, present, missing, unexpected, duplicates,
    mismatched, failed, passed, reported_total, reported_passed, integrity, worst, findings.

    cases: run, case, digest, passed; manifest: case, digest (each case once);
    reported: run, total, passed as the run's own report has them. A run without
    cases is there with zeros. Integrity is INVALID where cases are unexpected,
    repeated or of another digest, PARTIAL where some are missing, else FULL.
    findings: codes with their counts, the gravest first; worst: BLOCK, WARN or OK.
    """
    known = manifest.select(F.col("case").alias("_case"), F.col("digest").alias("_digest"))
    per_case = cases.groupBy("run", "case").agg(F.count("*").alias("copies"), F.count_if("passed").alias("passed"), F.collect_set("digest").alias("digests"))
    met = per_case.join(known, F.col("case") == F.col("_case"), "left")
    there = F.col("_case").isNotNull()
    sums = met.groupBy("run").agg(
        F.count_if(there).alias("present"),
        F.count_if(~there).alias("unexpected"),
        F.count_if(F.col("copies") > 1).alias("duplicates"),
        F.count_if(there & F.coalesce(F.exists("digests", lambda d: d != F.col("_digest")), F.lit(False))).alias("mismatched"),
        F.count_if(F.col("passed") == 0).alias("failed"),
        F.count_if(F.col("passed") > 0).alias("passed"),
    )
    own = reported.select(F.col("run").alias("_run"), F.col("total").alias("reported_total"), F.col("passed").alias("reported_passed"))
    rows = sums.join(own, F.col("run") == F.col("_run"), "full_outer").withColumn("run", F.coalesce("run", "_run")).drop("_run")
    zero = ["present", "unexpected", "duplicates", "mismatched", "failed", "passed"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    expected = manifest.count()
    rows = rows.withColumn("expected", F.lit(expected).cast("long")).withColumn("missing", F.lit(expected) - F.col("present"))
    gap = F.when(F.col("reported_total").isNotNull(), F.abs(F.col("reported_total") - F.col("present") - F.col("unexpected")) + F.abs(F.coalesce("reported_passed", F.lit(0)) - F.col("passed")))
    counts = {"UNEXPECTED_CASES": F.col("unexpected"), "DIGEST_MISMATCH": F.col("mismatched"), "DUPLICATE_CASES": F.col("duplicates"), "REPORT_DISAGREES": gap, "MISSING_CASES": F.col("missing"), "FAILED_CASES": F.col("failed"), "NOT_REPORTED": F.col("reported_total").isNull().cast("long")}
    listed = F.array_compact(F.array(*(F.when(counts[code] > 0, F.struct(F.lit(code).alias("code"), F.lit(kind).alias("severity"), counts[code].cast("long").alias("n"))) for code, kind in SEVERITY.items())))
    invalid = (F.col("unexpected") > 0) | (F.col("mismatched") > 0) | (F.col("duplicates") > 0)
    rows = rows.withColumn("findings", listed)
    worst = F.when(F.exists("findings", lambda f: f["severity"] == "BLOCK"), "BLOCK").when(F.size("findings") > 0, "WARN").otherwise("OK")
    integrity = F.when(invalid, "INVALID").when(F.col("missing") > 0, "PARTIAL").otherwise("FULL")
    return rows.select("run", "expected", "present", "missing", "unexpected", "duplicates", "mismatched", "failed", "passed", "reported_total", "reported_passed", integrity.alias("integrity"), worst.alias("worst"), "findings")


def checked_manifest(header: Mapping[str, object], cases: DataFrame, files: DataFrame, split: str) -> DataFrame:
    """case_id, relative_path, sha256, code of a manifest's cases; OK, or the first rule that a case breaks.

    header must name the split, a version and a source. cases: case_id,
    relative_path, sha256, external_id, expected (array of ids, may be empty);
    ids and digests are each there once. files: path and sha256 of what is stored,
    paths relative to the manifest's folder.
    """
    if header.get("split") != split:
        raise ValueError(f"the manifest is of split {header.get('split')!r}, not {split!r}")
    if not header.get("dataset_version") or not header.get("source"):
        raise ValueError("a manifest names its version and source")
    twice = lambda c: cases.groupBy(F.col(c).alias(f"_{c}")).agg(F.count("*").alias(f"_n_{c}")).where(F.col(f"_n_{c}") > 1)
    stored = files.select(F.col("path").alias("_path"), F.col("sha256").alias("_stored")).dropDuplicates(["_path"])
    rows = cases.join(twice("case_id"), F.col("case_id") == F.col("_case_id"), "left").join(twice("sha256"), F.col("sha256") == F.col("_sha256"), "left").join(stored, F.col("relative_path") == F.col("_path"), "left")
    empty = F.col("case_id").isNull() | F.col("relative_path").isNull() | F.col("external_id").isNull() | F.col("sha256").isNull()
    blank = F.exists(F.coalesce("expected", F.expr("cast(array() as array<string>)")), lambda x: x.isNull() | (F.trim(x) == ""))
    bad = empty | ~F.col("sha256").rlike("^[0-9a-f]{64}$") | F.col("_n_case_id").isNotNull() | F.col("_n_sha256").isNotNull() | blank
    climbs = F.col("relative_path").startswith("/") | F.col("relative_path").rlike(r"(^|/)\.\.(/|$)")
    code = F.when(F.coalesce(bad, F.lit(True)), "CASE_INVALID").when(climbs, "PATH_INVALID").when(F.col("_path").isNull(), "FILE_MISSING").when(F.col("_stored") != F.col("sha256"), "HASH_MISMATCH").otherwise("OK")
    return rows.select("case_id", "relative_path", "sha256", code.alias("code"))


DOCUMENT_KEYS = ("content", "text", "metadata", "external_id", "source_identifier")


def merged_document(text: Column, identifier) -> Column:
    """struct(content, metadata, error) of a JSON document; metadata: JSON text by key.

    content, or else text, must say something; identifiers beside the metadata are
    put into it and must not disagree with what it has; identifier: the rule that
    a source_identifier must pass (a function of its column, null if it fails).
    """
    v = F.try_parse_json(text)
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    said = lambda key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    has = lambda key: F.coalesce(F.map_contains_key(fields, F.lit(key)), F.lit(False))
    meta = F.try_variant_get(v, "$.metadata", "map<string,variant>")
    held = F.transform_values(F.coalesce(meta, F.expr("cast(map() as map<string,variant>)")), lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))
    content = F.when(has("content"), said("content")).otherwise(said("text"))
    own = {"external_id": said("external_id"), "source_identifier": identifier(said("source_identifier"))}
    # A text as JSON is what to_json writes for it.
    quoted = {k: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1) for k, c in own.items()}
    at = lambda key: F.try_element_at(held, F.lit(key))
    clash = [has(k) & F.map_contains_key(held, F.lit(k)) & ~at(k).eqNullSafe(quoted[k]) for k in own]
    unnamed = [has(k) & F.coalesce(F.trim(said(k)) == "", F.lit(True)) for k in own]
    parse = v.isNull()
    shape = fields.isNull() | F.exists(F.map_keys(fields), lambda k: ~k.isin(*DOCUMENT_KEYS)) | content.isNull() | (F.trim(content) == "") | (has("metadata") & meta.isNull())
    error = F.when(parse, "CORPUS_PARSE_FAILED").when(F.coalesce(shape | unnamed[0] | unnamed[1], F.lit(True)), "CORPUS_JSON_SCHEMA_INVALID")
    error = error.when(clash[0], "CORPUS_JSON_SCHEMA_INVALID").when(has("source_identifier") & own["source_identifier"].isNull(), "CORPUS_SOURCE_IDENTIFIER_INVALID")
    error = error.when(clash[1], "CORPUS_JSON_SCHEMA_INVALID")
    more = F.map_filter(F.create_map(*(x for k, q in quoted.items() for x in (F.lit(k), F.when(has(k), q)))), lambda k, x: x.isNotNull() & ~F.map_contains_key(held, k))
    fine = error.isNull()
    return F.struct(F.when(fine, content).alias("content"), F.when(fine, F.map_concat(held, more)).alias("metadata"), error.alias("error"))


def aged_orphans(files: DataFrame, known: DataFrame, path: str, modified: str, now: Column, least_age: Column) -> DataFrame:
    """path, finding: files that nothing names, TEMPORARY or ORPHAN once they are least_age
    old and RECENT before; named ones that aren't there, MISSING."""
    old = F.col(modified) + least_age <= now
    kind = F.when(~F.coalesce(old, F.lit(False)), "RECENT").when(F.col(path).startswith("tmp-"), "TEMPORARY").otherwise("ORPHAN")
    lost = files.join(known.select(path), path, "left_anti").select(path, kind.alias("finding"))
    return lost.unionByName(known.join(files, path, "left_anti").select(path, F.lit("MISSING").alias("finding")))
