"""Run folders as a data source, their sidecars, and a content-addressed store.

A run is a folder of case-NNNN.json files with a metadata.json beside them that
holds its own digest. `cases` is a Spark data source over it: files are split over
tasks by number, filters on case_number choose files before any is opened, and a
file whose name and content disagree, or a sidecar whose digest is another's, is
refused. Files are opened by pyarrow's file systems, so any store that has one
of them will do.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = re.compile(r"case-([0-9]{4,})\.json$")
SIDECAR = "metadata.json"


def store_of(uri: str):
    """pyarrow's file system of a folder and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def sidecar(metadata: dict) -> dict:
    """Metadata with the digest of its canonical JSON."""
    return {"metadata": metadata, "metadata_sha256": hashlib.sha256(canonical(metadata).encode()).hexdigest()}


def checked(text: str, where: str) -> dict:
    """The metadata of a sidecar's text; an error if it isn't one or its digest is another's."""
    found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("metadata"), dict):
        raise ValueError(f"{where} holds no metadata")
    if sidecar(found["metadata"]) != found:
        raise ValueError(f"the digest in {where} is not that of its metadata")
    return found["metadata"]


def write_sidecar(folder: str, metadata: dict) -> None:
    store, path = store_of(folder)
    with store.open_output_stream(f"{path}/{SIDECAR}") as f:
        f.write(canonical(sidecar(metadata)).encode() + b"\n")


def read_sidecar(folder: str) -> dict:
    """The run's metadata, empty where there is no sidecar."""
    from pyarrow import fs

    store, path = store_of(folder)
    if store.get_file_info(f"{path}/{SIDECAR}").type == fs.FileType.NotFound:
        return {}
    return checked(store.open_input_file(f"{path}/{SIDECAR}").read().decode(), f"{path}/{SIDECAR}")


class Files(InputPartition):
    def __init__(self, numbered: list[tuple[int, str]]):
        self.numbered = numbered


class CaseReader(DataSourceReader):
    """Lists names once, drops those that the filters exclude, opens the rest in tasks."""

    def __init__(self, folder: str, per_task: int, expected: int | None):
        self.folder, self.per_task, self.expected = folder, per_task, expected
        self.tests: list[tuple[str, Any]] = []

    def pushFilters(self, filters: list[Filter]):
        ways = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}
        for f in filters:
            if type(f) in ways and f.attribute == ("case_number",):
                self.tests.append((ways[type(f)], f.value))
            else:
                yield f

    def _wanted(self, number: int) -> bool:
        test = {"eq": lambda v: number == v, "gt": lambda v: number > v, "ge": lambda v: number >= v, "lt": lambda v: number < v, "le": lambda v: number <= v, "in": lambda v: number in v}
        return all(test[kind](value) for kind, value in self.tests)

    def partitions(self):
        from pyarrow import fs

        store, path = store_of(self.folder)
        read_sidecar(self.folder)
        names = [(int(m[1]), i.path) for i in store.get_file_info(fs.FileSelector(path)) if (m := NAME.search(i.path))]
        if self.expected is not None and (bad := [n for n, _ in names if not 1 <= n <= self.expected]):
            raise ValueError(f"case {min(bad)} is out of 1 to {self.expected}")
        kept = sorted((n, p) for n, p in names if self._wanted(n))
        return [Files(kept[at : at + self.per_task]) for at in range(0, len(kept), self.per_task)] or [Files([])]

    def read(self, partition):
        store, _ = store_of(self.folder)
        for number, path in partition.numbered:
            payload = store.open_input_file(path).read().decode()
            record = json.loads(payload)
            if record.get("case_number") != number:
                raise ValueError(f"{path} holds case {record.get('case_number')}")
            yield number, path.rsplit("/", 1)[-1], payload, hashlib.sha256(payload.encode()).hexdigest()


class CaseSource(DataSource):
    """spark.read.format("cases").load(folder); options per_task and expected (number of cases)."""

    @classmethod
    def name(cls):
        return "cases"

    def schema(self):
        return "case_number int, file string, payload string, sha256 string"

    def reader(self, schema):
        expected = self.options.get("expected")
        return CaseReader(self.options["path"], int(self.options.get("per_task", 64)), None if expected is None else int(expected))


def read_run(spark: SparkSession, folder: str, expected: int | None = None, per_task: int = 64) -> DataFrame:
    """The cases of a run; filters on case_number decide which files are opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaseSource)
    reader = spark.read.format("cases").option("per_task", per_task)
    return (reader if expected is None else reader.option("expected", expected)).load(folder)


def write_run(cases: DataFrame, folder: str, metadata: dict) -> None:
    """Writes case_number and payload (JSON text) as a run; tasks write their own files, each under its final name at once."""
    code = str(folder)

    def put(batches):
        import uuid

        import pyarrow as pa

        for batch in batches:
            store, path = store_of(code)
            for number, payload in zip(batch.column("case_number").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                draft = f"{path}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(payload.encode())
                store.move(draft, f"{path}/case-{number:04d}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    written = cases.select("case_number", "payload").mapInArrow(put, "n long").agg(F.sum("n")).first()[0]
    write_sidecar(folder, metadata | {"cases": written or 0})


class Cache:
    """Results kept under the digest of what they come from.

    The key is the digest of a name, the parameters and the inputs' own digests
    (fingerprint()). A miss computes and writes to a draft folder, which is
    renamed when whole; of two that compute the same, the first rename stands.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.hits, self.misses = spark, folder.rstrip("/"), 0, 0

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _publish(self, draft: str, final: str) -> None:
        """Renames the draft; where another has been there first, the draft goes."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        place, done = hadoop.Path(draft), hadoop.Path(final)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = hadoop.FileContext.getFileContext(place.toUri(), conf)
        try:
            context.rename(place, done, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if not context.util().exists(done):
                raise
            context.delete(place, True)

    def key(self, name: str, parameters: dict, *inputs: DataFrame) -> str:
        return hashlib.sha256(canonical({"name": name, "parameters": parameters, "inputs": [fingerprint(i) for i in inputs]}).encode()).hexdigest()

    def get(self, name: str, parameters: dict, inputs: list[DataFrame], compute) -> DataFrame:
        """The rows that compute(*inputs) gives, computed once for equal name, parameters and rows of the inputs."""
        import uuid

        final = f"{self.folder}/{self.key(name, parameters, *inputs)}"
        store, done = self._hadoop(final)
        if store.exists(done):
            self.hits += 1
        else:
            self.misses += 1
            draft = f"{self.folder}/.draft-{uuid.uuid4().hex}"
            compute(*inputs).write.parquet(draft)
            self._publish(draft, final)
        return self.spark.read.parquet(final)


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order or partitions: two sums of 128 bits over the rows' SHA-256."""
    from glosswork.functions.canonical import record_digest

    digest = record_digest(df, sorted(df.columns))
    halves = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    row = df.select(*(h.alias(f"h{i}") for i, h in enumerate(halves))).agg(F.count("*"), *(F.sum(f"h{i}") for i in range(4))).first()
    return hashlib.sha256(canonical([sorted(df.dtypes), *map(str, row)]).encode()).hexdigest()
