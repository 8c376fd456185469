"""Token ids in flat binary files.

Documents are range-partitioned by id and sorted; each task writes one file of
unsigned integers (16 bits where the vocabulary allows) and one index of 64-bit
offsets and ids. Partition bases are prefix sums over the files' totals, one row
a file. Readers map the files to memory and find any document by its offsets.

Layout of a part: tokens.bin (ids), index.bin (int64: n, then n + 1 offsets in
ids, then n document ids; a null id is the smallest int64). manifest.json lists
the parts in order with their totals and bases. A task writes to a name of its
own attempt and renames, so a task that runs twice leaves one whole file.

Defined cases: null text counts as empty (the end id alone); documents that
repeat an id follow each other by their text's hash (so that one id may cross parts); null ids come first; an empty
table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import ROOT, local_path, new_path, shuffle_partitions, table, text_of

NULL_ID = -(1 << 63)


def filesystem(uri: str):
    """pyarrow's file system of uri and the path in it."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def bits_for(tokenizer_path: str, end_id: int) -> int:
    """16 where all ids of the vocabulary and the end id fit, else 32."""
    import json

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return 16 if most < 1 << 16 else 32


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, bits: int | None = None) -> list[dict]:
    """Writes the files and the manifest; returns the manifest's parts.

    bits: of an id, by default what the vocabulary needs; fewer are refused.
    """
    import json

    needed = bits_for(tokenizer_path, end_id)
    bits = bits or needed
    if bits < needed:
        raise ValueError(f"ids of this vocabulary need {needed} bits, not {bits}")

    spark, root = docs.sparkSession, ROOT

    def run(batches):
        import sys
        import uuid

        import numpy as np
        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from pyspark import TaskContext

        from glosswork.llm.bpe import word_encoder
        from glosswork.llm.token_files import NULL_ID, filesystem

        part = TaskContext.get().partitionId()
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        kind = np.dtype(f"<u{bits // 8}")
        coder, tail = word_encoder(tokenizer_path), np.array([end_id], kind).tobytes()
        mine = f"{path}/part-{part:06d}"
        draft = f"{mine}.{uuid.uuid4().hex}"
        ids, sizes, out = [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                if out is None:
                    out = store.open_output_stream(f"{draft}.bin")
                some = batch.slice(at, 512)
                ids += [NULL_ID if i is None else i for i in some.column("doc_id").to_pylist()]
                for tokens in coder.encode_many(some.column("text").to_pylist()):
                    out.write(np.frombuffer(tokens, "<u4").astype(kind).tobytes() + tail)
                    sizes.append(len(tokens) // 4 + 1)
        if out is None:
            return
        out.close()
        index = np.concatenate([[len(ids)], [0], np.cumsum(sizes), ids]).astype("<i8")
        with store.open_output_stream(f"{draft}.idx") as f:
            f.write(index.tobytes())
        store.move(f"{draft}.bin", f"{mine}.tokens.bin")
        store.move(f"{draft}.idx", f"{mine}.index.bin")
        row = [[part], [len(ids)], [int(sum(sizes))]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in row], names=["part", "n_docs", "n_tokens"])

    ordered = text_of(docs).repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    totals = sorted(map(tuple, ordered.mapInArrow(run, "part long, n_docs long, n_tokens long").collect()))
    parts, base = [], 0
    for part, n_docs, n_tokens in totals:
        parts.append({"part": part, "n_docs": n_docs, "n_tokens": n_tokens, "base": base, "bits": bits})
        base += n_tokens
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"bits": bits, "end_id": end_id, "parts": parts}).encode())
    return parts


def open_part(folder: str, part: int, bits: int):
    """(ids, offsets, doc ids) of a part, mapped to memory where the store allows."""
    import numpy as np

    path = local_path(folder)
    names = [f"part-{part:06d}.tokens.bin", f"part-{part:06d}.index.bin"]
    if path:
        tokens = np.memmap(f"{path}/{names[0]}", f"<u{bits // 8}", "r")
        index = np.memmap(f"{path}/{names[1]}", "<i8", "r")
    else:
        store, path = filesystem(folder)
        tokens = np.frombuffer(store.open_input_file(f"{path}/{names[0]}").read_buffer(), f"<u{bits // 8}")
        index = np.frombuffer(store.open_input_file(f"{path}/{names[1]}").read_buffer(), "<i8")
    n = int(index[0])
    return tokens, index[1 : n + 2], index[n + 2 :]


def read_back(spark, folder: str, parts: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    root, bits = ROOT, parts[0]["bits"] if parts else 16

    def run(batches):
        import sys
        import zlib

        import numpy as np
        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.token_files import NULL_ID, open_part

        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                tokens, offsets, ids = open_part(folder, part, bits)
                for at in range(0, len(ids), 4096):
                    ends = offsets[at : at + 4097]
                    crc = [zlib.crc32(np.asarray(tokens[a:b]).astype("<u4")) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    own = np.asarray(ids[at : at + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(base + np.asarray(ends[:-1]), pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = spark.createDataFrame([(p["part"], p["base"]) for p in parts], "part long, base long")
    return rows.repartitionByRange(max(1, len(parts)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    return read_back(docs.sparkSession, folder, write(docs, tokenizer_path, end_id, folder))


def query(spark, sf_dir):
    import public_tokenizers

    return write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
