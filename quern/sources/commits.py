"""One commit for several tables: output, state and progress of a batch appear together or not at all.

Tasks write files of their own and report their lengths; the commit is one record, put in place by a rename, that
names the files of all tables with the bytes that count, and the progress.  Readers go by the records alone, so what a
killed writer has left, between data and commit or behind the end of a file, is never read, and ``recover`` removes it.
A batch that is committed already is not committed again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.runtime import ship
from quern.sources.ranges import RANGE_BYTES, _file_system, json_lines, size_of


def _record(folder: str, batch: int) -> str:
    return f"{folder}/commits/{batch:012d}.json"


def _listed(folder: str) -> list:
    from pyarrow import fs

    system, inner = _file_system(folder)
    return [i for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True)) if i.is_file]


def commits(folder: str) -> list[dict]:
    """All commit records in the order of their batches; half-written ones have another name."""
    found = sorted((i for i in _listed(f"{folder}/commits") if i.path.endswith(".json")), key=lambda i: i.path)
    system, _ = _file_system(folder)
    out = []
    for info in found:
        with system.open_input_file(info.path) as f:
            out.append(json.loads(f.read()))
    return out


def last_commit(folder: str) -> dict | None:
    """The newest record (batch, progress, files), from which a restart goes on."""
    found = commits(folder)
    return found[-1] if found else None


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (table, path below the folder, bytes, rows)."""

    files: list = field(default_factory=list)


class TwoPhase(DataSource):
    """Sink of rows (table, line); options: folder, batch, progress (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "two_phase"

    def schema(self) -> str:
        return "table string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TwoPhaseWriter(self.options["folder"], int(self.options["batch"]), json.loads(self.options["progress"]))


class TwoPhaseWriter(DataSourceWriter):
    def __init__(self, folder: str, batch: int, progress: dict):
        self.folder, self.batch, self.progress = folder, batch, progress

    def write(self, iterator: Iterator[Row]) -> Written:
        system, inner = _file_system(self.folder)
        name, streams, counts = uuid.uuid4().hex, {}, {}
        done = Written()
        try:
            for table, line in iterator:
                if table not in streams:
                    system.create_dir(f"{inner}/{table}", recursive=True)
                    streams[table] = system.open_output_stream(f"{inner}/{table}/{self.batch:012d}-{name}.jsonl")
                    counts[table] = [0, 0]
                data = line.encode() + b"\n"
                streams[table].write(data)
                counts[table][0] += len(data)
                counts[table][1] += 1
        except BaseException:
            for table, stream in streams.items():
                stream.close()
                system.delete_file(f"{inner}/{table}/{self.batch:012d}-{name}.jsonl")
            raise
        for table, stream in streams.items():
            stream.close()
            done.files.append([table, f"{table}/{self.batch:012d}-{name}.jsonl", *counts[table]])
        return done

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, target = _file_system(_record(self.folder, self.batch))
        if system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            return
        files = sorted(f for m in messages if m is not None for f in m.files)
        record = {"batch": self.batch, "progress": self.progress, "files": files}
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        beside = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as f:
            f.write(json.dumps(record).encode())
        system.move(beside, target)

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = _file_system(self.folder)
        for m in messages:
            for _, path, _, _ in m.files if m is not None else []:
                system.delete_file(f"{inner}/{path}")


def commit_batch(spark: SparkSession, folder: str, batch: int, tables: dict[str, DataFrame], progress: dict) -> bool:
    """Write all tables and the progress of a batch under one commit; False where the batch has been committed before."""
    if "commits" in tables or not tables:
        raise ValueError("a table, and none named commits")
    if any(r["batch"] == batch for r in commits(folder)):
        return False
    ship(spark)
    spark.dataSource.register(TwoPhase)
    rows = None
    for name, df in tables.items():
        lines = df.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("line"))
        rows = lines if rows is None else rows.unionByName(lines)
    rows.write.format("two_phase").mode("append").option("folder", folder).option("batch", str(batch)).option("progress", json.dumps(progress)).save()
    return True


def committed(spark: SparkSession, folder: str, table: str, schema: str | StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of a table, with the batch that committed them: files and bytes of the records, and no others."""
    stops = {f"{folder}/{path}": (size, record["batch"]) for record in commits(folder) for name, path, size, _ in record["files"] if name == table}
    if not stops:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    rows = json_lines(spark, schema, *stops, stop={p: s for p, (s, _) in stops.items()}, range_bytes=range_bytes)
    return rows.withColumn("batch", F.regexp_extract("file", r"(\d{12})-[0-9a-f]+\.jsonl$", 1).cast("long")).drop("file", "start", "_position")


def recover(folder: str) -> list[str]:
    """Delete files that no commit names; a file shorter than committed is an error.  Returns what went.

    Only for a start, when no other writer is at work in the folder.
    """
    named = {path: size for record in commits(folder) for _, path, size, _ in record["files"]}
    for path, size in named.items():
        if (there := size_of(f"{folder}/{path}")) < size:
            raise ValueError(f"{path} holds {there} of {size} committed bytes")
    system, inner = _file_system(folder)
    gone = [i.path for i in _listed(folder) if i.path[len(inner.rstrip("/")) + 1 :] not in named and not i.path.endswith(".json")]
    for path in gone:
        system.delete_file(path)
    return sorted(path[len(inner.rstrip("/")) + 1 :] for path in gone)
