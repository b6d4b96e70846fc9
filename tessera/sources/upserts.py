"""A store that is written as a data source of its own: staged files, one commit, upsert by key.

    spark.dataSource.register(UpsertSource)
    df.write.format("tessera_upsert").option("path", path).option("keys", "document_id,chunk_index").mode("append").save()
    rows = upserts.read(spark, path)

Each task writes its rows to a file that nothing refers to yet.  Once all tasks
are done, the commit lists the files that the tasks named, and only those, in the
store's next version: one small file, put in place by a rename.  A task that is
killed, tried twice or left over therefore changes nothing, and an aborted write
removes what it staged.  Reading takes each key's row from the last version that
has it (of equal keys in one version the largest row), so writing the same rows
twice gives the same rows.  ``compact`` writes what is read as one version.

Paths are URIs of stores that Arrow reaches (file, hdfs, s3, gs).  A null key is a
key like others; columns that a version lacks are null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task holds before it writes a row group.
GROUP_ROWS = 50_000


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    if "://" in path or path.startswith("file:/"):
        return pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pa.fs.LocalFileSystem(), path


def versions(path: str) -> list[dict]:
    """The commits in order: version, keys and files."""
    fs, root = _at(path)
    listed = fs.get_file_info(pa.fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = []
    for f in sorted((f.path for f in listed if f.path.endswith(".json"))):
        with fs.open_input_stream(f) as s:
            out.append(json.loads(s.read()))
    return out


@dataclass
class Staged(WriterCommitMessage):
    file: str | None
    rows: int


class UpsertWriter(DataSourceArrowWriter):
    def __init__(self, path: str, keys: list[str], schema: StructType, replace: bool):
        self.path, self.keys, self.replace = path, keys, replace
        self.schema, self.job = schema, uuid.uuid4().hex
        if missing := [k for k in keys if k not in schema.names]:
            raise ValueError(f"no column {missing[0]!r} for the key")

    def write(self, iterator) -> Staged:
        fs, root = _at(self.path)
        task = TaskContext.get()
        # Each attempt has a file of its own; the commit names one attempt's.
        name = f"data/{self.job}/part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet"
        writer, rows = None, 0
        try:
            for batch in iterator:
                if batch.num_rows == 0:
                    continue
                if writer is None:
                    fs.create_dir(f"{root}/data/{self.job}", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{name}", to_arrow_schema(self.schema), filesystem=fs)
                writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=to_arrow_schema(self.schema)), row_group_size=GROUP_ROWS)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Staged(name if rows else None, rows)

    def commit(self, messages) -> None:
        fs, root = _at(self.path)
        known = versions(self.path)
        number = known[-1]["version"] + 1 if known else 0
        files = sorted(m.file for m in messages if m and m.file)
        fs.create_dir(f"{root}/commits", recursive=True)
        staged = f"{root}/commits/.{self.job}"
        with fs.open_output_stream(staged) as s:
            s.write(json.dumps({"version": number, "keys": self.keys, "files": files, "rows": sum(m.rows for m in messages if m), "from": number if self.replace else 0}).encode())
        fs.move(staged, f"{root}/commits/{number:010d}.json")
        self._drop([f for f in self._staged() if f not in files])

    def abort(self, messages) -> None:
        self._drop(self._staged())

    def _staged(self) -> list[str]:
        fs, root = _at(self.path)
        listed = fs.get_file_info(pa.fs.FileSelector(f"{root}/data/{self.job}", allow_not_found=True))
        return [f"data/{self.job}/{f.base_name}" for f in listed]

    def _drop(self, files: list[str]) -> None:
        fs, root = _at(self.path)
        for f in files:
            fs.delete_file(f"{root}/{f}")


class UpsertSource(DataSource):
    """Options: path; keys, separated by commas.  Mode overwrite starts the store anew."""

    @classmethod
    def name(cls) -> str:
        return "tessera_upsert"

    def writer(self, schema: StructType, overwrite: bool) -> UpsertWriter:
        keys = [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]
        if not keys:
            raise ValueError("option keys is missing")
        return UpsertWriter(self.options["path"].rstrip("/"), keys, schema, overwrite)


def write(df: DataFrame, path: str, keys: list[str], mode: str = "append") -> None:
    df.sparkSession.dataSource.register(UpsertSource)
    df.write.format("tessera_upsert").option("path", path).option("keys", ",".join(keys)).mode(mode).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each key's row of the last version that has it."""
    known = versions(path)
    if not known:
        raise FileNotFoundError(f"no version of a store at {path}")
    known = [v for v in known if v["version"] >= known[-1]["from"]]
    parts = [spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{f}" for f in v["files"]]).withColumn("_version", F.lit(v["version"])) for v in known if v["files"]]
    if not parts:
        return spark.createDataFrame([], StructType())
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    keys = known[-1]["keys"]
    rest = [c for c in rows.columns if c not in keys and c != "_version"]
    # Partial maxima before the one shuffle: a key that came in every version is no hot key.
    last = rows.groupBy(*keys).agg(F.max(F.struct("_version", *rest)).alias("_row"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns if c != "_version"))


def compact(spark: SparkSession, path: str) -> None:
    """What is read, as one version that needs none before it."""
    write(read(spark, path), path, versions(path)[-1]["keys"], "overwrite")
