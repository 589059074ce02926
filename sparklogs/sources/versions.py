"""A chunk table that is merged when it is read: batches append versions of rows, compaction folds them into folders.

A batch writes its own rows and one log entry that names them, nothing else. Entries are numbered and put in place by a
rename that fails if the number is taken, so a batch is there as a whole or not at all, readers never see half of one, and
of two writers at the same number one fails. Batches of one size class are merged among themselves; once all of them
together are a fair part of the table, only the folders that they or a split touch are written again. Folders grow by
linear hashing: the table gets one more at a time, and a new one takes rows from one other alone. Files that no entry
names any more stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER_BYTES = 128 << 20
#: Batches of one size class that are merged into one, and the factor between classes.
CLASS = 8
SMALLEST = 64 << 10
#: Batches are folded in once they have this part of the table's bytes.
PART = 4
VERSION = "_version"


class Conflict(RuntimeError):
    """Another writer has taken the number of this entry."""


def folder_of(key: str | Column, folders: int) -> Column:
    """The folder of a key, by linear hashing: with one more folder a key stays or moves into the new one."""
    low = 1 << (folders.bit_length() - 1)
    h = F.xxhash64(key)
    wide = F.pmod(h, F.lit(2 * low))
    return F.when(wide < folders, wide).otherwise(F.pmod(h, F.lit(low))).cast("int")


def split_from(new: int, folders: int) -> int:
    """The one of the first ``folders`` folders that folder ``new`` takes its rows from."""
    while new >= folders:
        new -= 1 << (new.bit_length() - 1)
    return new


@dataclass
class State:
    """What the log says: the number of the last entry, live files and their bytes."""

    version: int = 0
    folders: int = 1
    schema: str | None = None
    base: dict[int, list[tuple[str, int]]] = field(default_factory=dict)
    deltas: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def base_bytes(self) -> int:
        return sum(b for own in self.base.values() for _, b in own)


class ChunkTable:
    """The table at ``path``, keyed by ``key``. The store needs an atomic rename, as HDFS and local disks have."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", folder_bytes: int = FOLDER_BYTES, smallest: int = SMALLEST):
        self.spark, self.path, self.key, self.folder_bytes, self.smallest = spark, path.rstrip("/"), key, folder_bytes, smallest
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._at = hadoop.fs.Path
        root = self._at(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._no_options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # The log

    def _entries(self) -> list[str]:
        """Names of the entries, in order."""
        folder = self._at(f"{self.path}/_log")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json") and n[0].isdigit())

    def _read_entry(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/_log/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> State:
        """Replay the log from its last snapshot on."""
        since: list[tuple[str, dict]] = []
        for name in reversed(self._entries()):
            since.append((name, self._read_entry(name)))
            if since[-1][1]["snapshot"]:
                break
        out = State()
        for name, entry in reversed(since):
            out.version, out.folders, out.schema = int(name.split(".")[0]), entry["folders"], entry["schema"]
            gone = set(entry["remove"])
            out.deltas = {p: b for p, b in out.deltas.items() if p not in gone} | dict(entry["deltas"])
            if entry["snapshot"]:
                out.base = {int(k): own for k, own in entry["base"].items()}
            out.batches |= entry["batches"]
        return out

    def _commit(self, state: State, deltas: dict[str, int], remove: list[str], snapshot: bool = False) -> None:
        number = state.version + 1
        entry = {"snapshot": snapshot, "folders": state.folders, "schema": state.schema, "deltas": list(deltas.items()), "remove": remove, "base": state.base if snapshot else {}, "batches": state.batches}
        made = self._at(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            self._context.rename(made, self._at(f"{self.path}/_log/{number:020d}.json"), self._no_options)
        except Exception as e:
            self._fs.delete(made, False)
            raise Conflict(f"entry {number} of {self.path} is taken") from e
        state.version = number

    def _bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._at(f"{self.path}/{path}")).getLength()

    # Reading

    def _latest(self, state: State, paths: list[str], schema: T.StructType) -> DataFrame:
        """The last version of each key in some batches, with its number."""
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])).parquet(*[f"{self.path}/{p}" for p in paths])
        last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc(VERSION)))
        return rows.withColumn("_n", last).where("_n = 1").drop("_n")

    def _base(self, state: State, folders: list[int], schema: T.StructType) -> DataFrame:
        files = [f"{self.path}/{p}" for k in folders for p, _ in state.base.get(k, [])]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The last version of each row. Without batches to merge this is a plain scan."""
        state = self.state()
        if state.schema is None:
            raise ValueError(f"{self.path} has no rows yet")
        schema = T.StructType.fromJson(json.loads(state.schema))
        base = self._base(state, sorted(state.base), schema)
        if not state.deltas:
            return base
        latest = self._latest(state, list(state.deltas), schema).drop(VERSION)
        return base.join(latest.select(self.key), self.key, "left_anti").select(schema.names).unionByName(latest) if state.base else latest

    # Writing

    def upsert(self, rows: DataFrame, order: str | Column, writer: str = "", batch: int | None = None) -> None:
        """Put rows in by key; of several the first by ``order`` counts (a name: its greatest value). They take the place of
        rows of earlier batches. With ``batch``, a number that this ``writer`` has already put in is left out."""
        state = self.state()
        if batch is not None and state.batches.get(writer, -1) >= batch:
            return
        first = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc_nulls_last(order) if isinstance(order, str) else order))
        once = rows.withColumn("_n", first).where("_n = 1").drop("_n").withColumn(VERSION, F.lit(state.version + 1).cast("long"))
        made = f"delta-{uuid.uuid4().hex}"
        once.write.parquet(f"{self.path}/{made}")
        state.schema = state.schema or rows.schema.json()
        if batch is not None:
            state.batches[writer] = batch
        self._commit(state, {made: self._bytes(made)}, [])
        self.maintain()

    def maintain(self) -> None:
        """Merge batches of one size class; fold all of them into the folders if they are a fair part of the table."""
        state = self.state()
        if sum(state.deltas.values()) >= max(state.base_bytes() // PART, self.folder_bytes // PART):
            self.compact()
            return
        classes: dict[int, list[str]] = {}
        for path, size in state.deltas.items():
            level, most = 0, self.smallest
            while size > most:
                level, most = level + 1, most * CLASS
            classes.setdefault(level, []).append(path)
        for own in classes.values():
            if len(own) >= CLASS:
                made = f"delta-{uuid.uuid4().hex}"
                self._latest(state, own, T.StructType.fromJson(json.loads(state.schema))).write.parquet(f"{self.path}/{made}")
                self._commit(state, {made: self._bytes(made)}, own)

    def compact(self) -> None:
        """Fold all batches into the folders that they touch, and add folders as the table has grown."""
        state = self.state()
        if not state.deltas:
            return
        schema = T.StructType.fromJson(json.loads(state.schema))
        latest = self._latest(state, list(state.deltas), schema).drop(VERSION)
        before, total = state.folders, state.base_bytes() + sum(state.deltas.values())
        state.folders = max(before, -(-total // self.folder_bytes))
        # at most one number a folder
        touched = {r["folder"] for r in latest.select(folder_of(self.key, before).alias("folder")).distinct().collect()} | {split_from(k, before) for k in range(before, state.folders)}
        base = self._base(state, sorted(touched), schema)
        merged = base.join(latest.select(self.key), self.key, "left_anti").select(schema.names).unionByName(latest)
        made = f"base-{uuid.uuid4().hex}"
        folder = "_folder"
        merged.withColumn(folder, folder_of(self.key, state.folders)).repartition(folder).write.partitionBy(folder).parquet(f"{self.path}/{made}")
        removed = list(state.deltas)
        state.base = {k: own for k, own in state.base.items() if k not in touched}
        for status in self._fs.listStatus(self._at(f"{self.path}/{made}")):
            name = status.getPath().getName()
            if name.startswith(f"{folder}="):
                state.base.setdefault(int(name.split("=")[1]), []).append((f"{made}/{name}", self._bytes(f"{made}/{name}")))
        self._commit(state, {}, removed, snapshot=True)

    def vacuum(self) -> None:
        """Delete files that the last state does not name; nobody may be reading an earlier state or writing."""
        state = self.state()
        live = set(state.deltas) | {p for own in state.base.values() for p, _ in own}
        for status in self._fs.listStatus(self._at(self.path)):
            name = status.getPath().getName()
            if name.startswith("base-"):
                for inner in self._fs.listStatus(status.getPath()):
                    if f"{name}/{inner.getPath().getName()}" not in live:
                        self._fs.delete(inner.getPath(), True)
            elif name.startswith("delta-") and name not in live:
                self._fs.delete(status.getPath(), True)
