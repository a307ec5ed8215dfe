"""A sink and source of many small files: payloads in pack files, with a manifest that only whole writes get into."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: A pack file ends with the payload that reaches this size.
PACK_BYTES = 64 << 20
#: Payloads that are read back are handed on about so many bytes at a time.
BATCH_BYTES = 8 << 20
ENTRY = "name string, file string, start long, size long, sha256 string"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its own list of entries, and the files."""

    entries: str
    packs: list[str]


class ArtifactSource(DataSource):
    """``df.write.format("artifacts").option("path", …).mode("append")`` with the columns name (string) and payload (binary).

    ``path`` is a folder that the executors and the driver share, as a url of a store that pyarrow opens
    (``file:///…`` and others). Null payloads are not written; a null name is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("artifacts are only appended")
        return ArtifactWriter(self.options["path"], int(self.options.get("packbytes", PACK_BYTES)), schema.fieldNames())


class ArtifactWriter(DataSourceWriter):
    """Each task writes pack files under names of its own; a job's commit is one small file that names the tasks' lists."""

    def __init__(self, path: str, pack_bytes: int, columns: list[str]) -> None:
        if not {"name", "payload"} <= set(columns):
            raise ValueError("artifacts have the columns name and payload")
        self.path, self.pack_bytes = path.rstrip("/"), pack_bytes

    def folder(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.path)
        for part in ("packs", "entries", "commits"):
            store.create_dir(f"{root}/{part}", recursive=True)
        return store, root

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self.folder()
        packs: list[str] = []
        entries = f"entries/{uuid.uuid4().hex}.json"  # another name each attempt: attempts don't meet
        out, at = None, 0
        try:
            with store.open_output_stream(f"{root}/{entries}", compression=None) as told:
                for r in iterator:
                    if r["name"] is None:
                        raise ValueError("an artifact has no name")
                    if r["payload"] is None:
                        continue
                    if out is None:
                        packs.append(f"packs/{uuid.uuid4().hex}.bin")
                        out, at = store.open_output_stream(f"{root}/{packs[-1]}", compression=None), 0
                    data = bytes(r["payload"])
                    out.write(data)
                    told.write(json.dumps({"name": r["name"], "file": packs[-1], "start": at, "size": len(data), "sha256": hashlib.sha256(data).hexdigest()}).encode() + b"\n")
                    at += len(data)
                    if at >= self.pack_bytes:
                        out.close()
                        out = None
        except BaseException:
            self.remove([Written(entries, packs)])
            raise
        finally:
            if out is not None:
                out.close()
        return Written(entries, packs)

    def remove(self, messages: list[Written | None]) -> None:
        store, root = self.folder()
        for m in messages:
            for file in [m.entries, *m.packs] if m else []:
                if store.get_file_info(f"{root}/{file}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{file}")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self.folder()
        with store.open_output_stream(f"{root}/commits/{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({"entries": [m.entries for m in messages if m]}).encode())  # a line a task

    def abort(self, messages: list[Written | None]) -> None:
        self.remove(messages)


def write_artifacts(rows: DataFrame, path: str, **options: int) -> None:
    """Append the rows (name, payload) to the artifacts in a folder; all of them, or none that the manifest names."""
    rows.sparkSession.dataSource.register(ArtifactSource)
    rows.select("name", "payload").write.format("artifacts").option("path", path).options(**options).mode("append").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, start, size, sha256) of everything that a job has written to its end."""
    commits = spark.read.schema("entries array<string>").json(f"{path}/commits")
    wanted = commits.select(F.explode("entries").alias("entries")).distinct()
    listed = spark.read.schema(ENTRY).json(f"{path}/entries").withColumn("entries", F.concat(F.lit("entries/"), F.element_at(F.split(F.input_file_name(), "/"), -1)))
    return listed.join(wanted, "entries", "left_semi").drop("entries")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, payload, whole): the payloads back, and whether each has the checksum it was written with.

    The manifest's rows are dealt by pack file, in its order; each task reads the ranges that its rows name.
    """
    dealt = manifest(spark, path).repartition("file").sortWithinPartitions("file", "start")
    told = dealt.select("name", "file", "start", "size", "sha256").mapInArrow(partial(_ranges, path.rstrip("/")), "name string, payload binary, sha256 string")
    return told.select("name", "payload", (F.sha2("payload", 256) == F.col("sha256")).alias("whole"))


def _ranges(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each row's range, in batches of about ``BATCH_BYTES``; what a damaged file lacks is left out."""
    store, root = fs.FileSystem.from_uri(path)
    name, pack = None, None
    for b in batches:
        rows, payloads, held = b.select(["name", "sha256"]), [], 0
        first = 0
        for k, (file, start, size) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "start", "size")), strict=True)):
            if size and file != name:
                if pack is not None:
                    pack.close()
                name, pack = file, store.open_input_file(f"{root}/{file}")
            if size:
                pack.seek(min(start, pack.size()))
            payloads.append(pack.read(size) if size else b"")
            held += size
            if held >= BATCH_BYTES or k == b.num_rows - 1:
                some = rows.slice(first, len(payloads))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(payloads, pa.binary()), some.column(1)], names=["name", "payload", "sha256"])
                first, payloads, held = k + 1, [], 0
    if pack is not None:
        pack.close()
