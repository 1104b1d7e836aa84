"""A store of nodes, links and their values that can only be read once it is sealed.

Tables are Parquet folders below a root; sealing checks that every value table has one row per node
or link and writes the marker last, so a reader never sees a half-written store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import InvalidFormatError

NODES, LINKS, MARK = "nodes", "links", "_SEALED"


class SealedStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    @property
    def sealed(self) -> bool:
        return self._there(MARK)

    def _open(self) -> None:
        if self.sealed:
            raise InvalidFormatError("the store is sealed; unseal it to write")

    def _add(self, name: str, rows: DataFrame, columns: tuple[str, ...]) -> None:
        """Appends; ``n`` is the place of a row, given by the caller and unique."""
        self._open()
        rows.select("n", *columns).write.mode("append").parquet(f"{self.root}/{name}")

    def add_nodes(self, rows: DataFrame) -> None:
        self._add(NODES, rows, ("seqid", "start", "end"))

    def add_links(self, rows: DataFrame) -> None:
        self._add(LINKS, rows, ("source", "target"))

    def add_node_values(self, key: str, rows: DataFrame) -> None:
        self._add(f"{NODES}_{key}", rows, ("value",))

    def add_link_values(self, key: str, rows: DataFrame) -> None:
        self._add(f"{LINKS}_{key}", rows, ("value",))

    def seal(self) -> None:
        """Checks places and row numbers, then writes the marker."""
        for base in (NODES, LINKS):
            if not self._there(base):
                continue
            size, places = self.spark.read.parquet(f"{self.root}/{base}").agg(F.count("*"), F.count_distinct("n")).first()
            if size != places:
                raise InvalidFormatError(f"{base} has repeated places")
            for name in self.values(base):
                n = self.spark.read.parquet(f"{self.root}/{base}_{name}").agg(F.count_distinct("n")).first()[0]
                if n != size:
                    raise InvalidFormatError(f"{base}_{name} has {n} rows for {size} {base}")
        self._fs.create(self._path(f"{self.root}/{MARK}"), True).close()

    def unseal(self) -> None:
        self._fs.delete(self._path(f"{self.root}/{MARK}"), False)

    def values(self, base: str = NODES) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(x.removeprefix(base + "_") for x in names if x.startswith(base + "_"))

    def _read(self, name: str) -> DataFrame:
        if not self.sealed:
            raise InvalidFormatError("the store isn't sealed")
        if not self._there(name):
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def nodes(self, first: int | None = None, end: int | None = None) -> DataFrame:
        """Nodes, or those of the places from ``first`` up to ``end``."""
        df = self._read(NODES)
        if first is not None:
            df = df.where(F.col("n") >= first)
        return df if end is None else df.where(F.col("n") < end)

    def links(self) -> DataFrame:
        return self._read(LINKS)

    def node_values(self, key: str) -> DataFrame:
        return self._read(f"{NODES}_{key}")

    def link_values(self, key: str) -> DataFrame:
        return self._read(f"{LINKS}_{key}")
