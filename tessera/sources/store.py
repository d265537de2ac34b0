"""Write-once tables by content, and workspace defaults."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content(df: DataFrame) -> tuple[int, str]:
    """Number of rows of a table, and a hash of its schema and rows, whatever their order and partitions.

    Row hashes are summed in two exact decimals, so no row leaves its partition.
    """
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    got = df.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b")).first()
    text = json.dumps([[n, df.schema[n].dataType.simpleString()] for n in names]) + f"|{got['n']}|{got['a']}|{got['b']}"
    return got["n"], hashlib.sha256(text.encode()).hexdigest()


def content_id(df: DataFrame) -> str:
    return content(df)[1]


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; only where that is unset, in local mode, in
    a temporary folder, which driver and executors then share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df cut from its lineage: written to a shared folder, and read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


class Store:
    """Tables under root/kind/aa/bb/<id>; putting what is there already changes nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, key: str) -> str:
        return f"{self.root}/{kind}/{key[:2]}/{key[2:4]}/{key}"

    def has(self, kind: str, key: str) -> bool:
        return is_whole(self.spark, self.path(kind, key))

    def put(self, kind: str, df: DataFrame) -> str:
        """Writes a table, which is worked out once, and names what was written by its content; what is there stays."""
        part = f"{self.root}/{kind}/{uuid.uuid4().hex}.part"
        df.write.parquet(part)
        key = content_id(self.spark.read.parquet(part))
        if self.has(kind, key):
            self._files(part)[0].delete(self._files(part)[1], True)
        else:
            self._move(part, self.path(kind, key))
        return key

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _move(self, part: str, path: str) -> None:
        (_, old), (fs, new) = self._files(part), self._files(path)
        fs.delete(new, True)  # what a failed write left
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"{part} could not be renamed")

    def get(self, kind: str, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, key))

    def copy(self, kind: str, key: str, to: Store) -> bool:
        """Copies a table to another store, unless it is there; false if it was. What is read and what was written
        must have the content that the id names; a copy that did not end has no mark, and is made again."""
        if to.has(kind, key):
            return False
        rows = self.get(kind, key)
        if content_id(rows) != key:
            raise ValueError(f"{kind} {key} is not what its id names")
        path, part = to.path(kind, key), f"{to.path(kind, key)}.part"
        rows.write.mode("overwrite").parquet(part)
        if content_id(self.spark.read.parquet(part)) != key:
            raise ValueError(f"{kind} {key} was not copied whole")
        to._move(part, path)
        return True


@dataclass(frozen=True)
class Workspace:
    """Default ids; a snapshot and its signatures go together, the rest are free."""

    merged_snapshot: str = ""
    merged_signatures: str = ""
    lexicon_snapshot: str = ""
    default_k: str = ""
    markov_model: str = ""
    exemplars: str = ""
    graph: str = ""

    @staticmethod
    def parse(text: str) -> Workspace:
        """key=value lines; blank lines and # comments are skipped, the last of a key counts."""
        known, got = {f.name for f in fields(Workspace)}, {}
        for number, raw in enumerate(text.splitlines(), 1):
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            key, eq, value = line.partition("=")
            if not eq:
                raise ValueError(f"line {number}: no '='")
            if key.strip() not in known:
                raise ValueError(f"line {number}: unknown key {key.strip()}")
            got[key.strip()] = value.strip()
        out = Workspace(**got)
        if bool(out.merged_snapshot) != bool(out.merged_signatures):
            raise ValueError("merged_snapshot and merged_signatures must be set together")
        return out

    def text(self) -> str:
        return "".join(f"{k}={v}\n" for k, v in asdict(self).items() if v)


def size_report(sizes: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Debug views of (artifact_id, kind, bytes): counts by kind, smallest ids, largest artifacts."""
    return {
        "by_kind": sizes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")),
        "smallest_ids": sizes.orderBy("artifact_id").limit(n),
        "largest": sizes.orderBy(F.col("bytes").desc(), "artifact_id").limit(n),
    }
