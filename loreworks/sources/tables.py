"""The index table: an append-only log of document versions, read as the latest version of each document.

A batch of replaced and removed documents is written once, as a delta (its rows, and a mark for each document), and
becomes visible by one file in ``_log``, whose name says all that a reader must know.  So the work of a write
follows the batch, a failed write is never seen, and a batch that is replayed under its tag is written once.  Reads lay
the deltas over the base: documents that a delta marks are dropped from the base.  Deltas are merged when they are
many, neighbours of like size together, and become part of a new base once they hold half as many documents as it does,
so a document is rewritten a logarithmic number of times.  The base is partitioned into buckets whose number
follows its size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET_KEYS = 100_000
MAX_DELTAS = 8
_ENTRY = re.compile(r"^(\d+)\.(base|delta)\.(\d+)\.(\d+)\.(\d+)\.(.*)$")


@dataclass(frozen=True)
class Part:
    """A committed folder: versions ``first`` to ``version``, its number of documents and of buckets."""

    version: int
    kind: str
    first: int
    keys: int
    buckets: int
    tag: str

    @property
    def name(self) -> str:
        return f"{self.version:012d}.{self.kind}.{self.first}.{self.keys}.{self.buckets}.{self.tag}"

    @property
    def folder(self) -> str:
        return f"{self.kind}-{self.first}-{self.version}"


class IndexTable:
    """Rows of documents named by ``key``; every write replaces all rows of the documents in it.

    ``by_prefix`` is for keys that are hexadecimal digests: buckets are ranges of them instead of hashes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", by_prefix: bool = False, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.path, self.key, self.by_prefix, self.bucket_keys = spark, path.rstrip("/"), key, by_prefix, bucket_keys

    # -- the log of commits ----------------------------------------------------------------------------

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(name)  # noqa: SLF001 - the public Hadoop file system API
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _log(self) -> list[Part]:
        place, fs = self._place(f"{self.path}/_log")
        if not fs.exists(place):
            return []
        found = (_ENTRY.match(s.getPath().getName()) for s in fs.listStatus(place))
        parts = [Part(int(m[1]), m[2], int(m[3]), int(m[4]), int(m[5]), m[6]) for m in found if m]
        return sorted(parts, key=lambda p: (p.version, p.first, p.kind))

    def _commit(self, part: Part) -> None:
        place, fs = self._place(f"{self.path}/_log/{part.name}")
        fs.create(place, False).close()  # refuses to take the place of another writer's

    def snapshot(self) -> tuple[Part | None, list[Part]]:
        """The latest base and the deltas that follow it, oldest first; merged ones stand for their parts."""
        log = self._log()
        bases = [p for p in log if p.kind == "base"]
        base = bases[-1] if bases else None
        since = base.version if base else 0
        deltas: list[Part] = []
        for p in sorted((p for p in log if p.kind == "delta" and p.version > since), key=lambda p: (p.first, -p.version)):
            if not deltas or p.version > deltas[-1].version:
                deltas.append(p)
        return base, deltas

    def has(self, tag: str) -> bool:
        return any(p.tag == re.sub(r"[^\w-]", "_", tag) for p in self._log())

    # -- writing ---------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, removed: DataFrame | None = None, tag: str = "") -> bool:
        """Replace the documents in ``rows`` and drop the ``removed`` ones; False if ``tag`` was written already.

        A document in both is replaced.
        """
        tag = re.sub(r"[^\w-]", "_", tag)
        if tag and self.has(tag):
            return False
        base, deltas = self.snapshot()
        version = 1 + max([p.version for p in [*deltas, *([base] if base else [])]], default=0)
        folder = f"{self.path}/delta-{version}-{version}"
        rows.write.mode("overwrite").parquet(f"{folder}/rows")
        live = self._read(f"{folder}/rows").select(self.key, F.lit(True).alias("_live"))
        gone = live.limit(0) if removed is None else removed.select(F.col(self.key).cast(live.schema[self.key].dataType), F.lit(False).alias("_live"))
        live.unionByName(gone).where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max("_live").alias("_live")).write.mode("overwrite").parquet(f"{folder}/marks")
        keys = self._read(f"{folder}/marks").count()
        self._commit(Part(version, "delta", version, keys, 0, tag))
        self._tidy()
        return True

    def _tidy(self) -> None:
        base, deltas = self.snapshot()
        if base and 2 * sum(p.keys for p in deltas) > base.keys or not base and len(deltas) > MAX_DELTAS:
            self.compact()
        elif len(deltas) > MAX_DELTAS:
            at, total = len(deltas) - 1, deltas[-1].keys
            while at > 0 and (at == len(deltas) - 1 or deltas[at - 1].keys <= 2 * total):
                at -= 1
                total += deltas[at].keys
            self._merge(deltas[at:])

    def _merge(self, deltas: list[Part]) -> None:
        """One delta in place of several that follow each other; marks of removed documents stay."""
        part = Part(deltas[-1].version, "delta", deltas[0].first, 0, 0, "merged")
        folder = f"{self.path}/{part.folder}"
        latest = self._latest(deltas)
        self._rows_of(deltas, latest).write.mode("overwrite").parquet(f"{folder}/rows")
        latest.select(self.key, "_live").write.mode("overwrite").parquet(f"{folder}/marks")
        self._commit(Part(part.version, "delta", part.first, self._read(f"{folder}/marks").count(), 0, "merged"))

    def compact(self) -> None:
        """A new base of the present rows, with a bucket for about ``bucket_keys`` documents."""
        base, deltas = self.snapshot()
        if not deltas:
            return
        most = sum(p.keys for p in deltas) + (base.keys if base else 0)
        buckets = 1 << max(0, (most - 1) // self.bucket_keys).bit_length()
        part = Part(deltas[-1].version, "base", 0, 0, buckets, "")
        rows = self.read().withColumn("_bucket", self._bucket(buckets))
        sorted_ = rows.repartition("_bucket").sortWithinPartitions("_bucket", self.key)
        sorted_.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{part.folder}")
        if not self._has_rows(part):  # an empty table keeps its schema
            rows.drop("_bucket").limit(0).write.mode("overwrite").parquet(f"{self.path}/{part.folder}/_bucket=0")
        kept = self._read(f"{self.path}/{part.folder}").agg(F.countDistinct(self.key)).first()[0]
        self._commit(Part(part.version, "base", 0, kept, buckets, ""))

    def vacuum(self) -> None:
        """Delete folders that the present snapshot doesn't use; nobody may be reading an older one."""
        base, deltas = self.snapshot()
        used = {p.folder for p in [*deltas, *([base] if base else [])]} | {"_log"}
        place, fs = self._place(self.path)
        for s in fs.listStatus(place):
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

    # -- reading ---------------------------------------------------------------------------------------

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _has_rows(self, part: Part) -> bool:
        place, fs = self._place(f"{self.path}/{part.folder}")
        return fs.exists(place) and any(s.getPath().getName().startswith("_bucket=") for s in fs.listStatus(place))

    def _bucket(self, buckets: int) -> Column:
        if self.by_prefix:
            return F.floor(F.conv(F.substring(self.key, 1, 6), 16, 10).cast("long") * buckets / (1 << 24)).cast("int")
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _latest(self, deltas: list[Part]) -> DataFrame:
        """``key, _version, _live``: the last mark of each document that a delta touches."""
        marks = [self._read(f"{self.path}/{p.folder}/marks").withColumn("_version", F.lit(p.version)) for p in deltas]
        every = marks[0]
        for m in marks[1:]:
            every = every.unionByName(m)
        return every.groupBy(self.key).agg(F.max("_version").alias("_version"), F.max_by("_live", "_version").alias("_live"))

    def _rows_of(self, deltas: list[Part], latest: DataFrame) -> DataFrame:
        rows = [self._read(f"{self.path}/{p.folder}/rows").withColumn("_version", F.lit(p.version)) for p in deltas]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r, allowMissingColumns=True)
        return every.join(latest.where("_live").select(self.key, "_version"), [self.key, "_version"], "left_semi").drop("_version")

    def _base_rows(self, base: Part | None) -> DataFrame | None:
        return self._read(f"{self.path}/{base.folder}") if base else None

    def _over(self, rows: DataFrame | None, deltas: list[Part], wanted: DataFrame | None = None) -> DataFrame:
        if not deltas:
            if rows is None:
                raise ValueError(f"no rows were ever written to {self.path}")
            return rows.drop("_bucket")
        latest = self._latest(deltas)
        if wanted is not None:
            latest = latest.join(wanted, self.key, "left_semi")
        newer = self._rows_of(deltas, latest)
        if rows is None:
            return newer
        return rows.drop("_bucket").join(latest, self.key, "left_anti").unionByName(newer, allowMissingColumns=True)

    def read(self) -> DataFrame:
        """All rows of the latest version of every document."""
        base, deltas = self.snapshot()
        return self._over(self._base_rows(base), deltas)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some documents; with few keys, only their buckets of the base are read."""
        base, deltas = self.snapshot()
        wanted = keys.select(self.key).distinct()
        rows = self._base_rows(base)
        if rows is not None:
            rows = rows.join(wanted.withColumn("_bucket", self._bucket(base.buckets)), [self.key, "_bucket"], "left_semi")
        return self._over(rows, deltas, wanted)


def write_index(rows: DataFrame, path: str, key: str = "doc_id", by_prefix: bool = False, bucket_keys: int = BUCKET_KEYS) -> IndexTable:
    """A new table of ``rows``, all of them in its base."""
    table = IndexTable(rows.sparkSession, path, key, by_prefix, bucket_keys)
    table.append(rows)
    table.compact()
    return table


def read_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    return IndexTable(spark, path, key).read()


def replace_documents(new: DataFrame, path: str, key: str = "doc_id", removed: DataFrame | None = None, tag: str = "") -> None:
    """Replace the documents in ``new`` (all their rows) and drop the ``removed`` ones."""
    IndexTable(new.sparkSession, path, key).append(new, removed, tag)
