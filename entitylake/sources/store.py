"""Where the layer tables live: catalog tables, files, or a database over JDBC."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entitylake.sources import splits

# One row per finished write of a file table: its folder, whether it replaced the
# table, and the versions of the tables it was made from.
COMMITS = "version long, folder string, replaces boolean, partitioned boolean, sources map<string, bigint>"


@dataclass
class LayerStore:
    """Tables named ``layer.table`` in one of three places.

    ``table``: catalog tables in a database per layer. ``parquet`` (or another
    file format): folders ``{root}/{layer}/{table}``. ``jdbc``: tables of that
    name in the database given by ``options`` (url, user, password, driver).
    ``table_options`` are reader options by table name, so that jobs read a
    large table in partitions.

    A file table is a log of commits: every write goes to a folder of its own, and
    the row that names the folder is added last. Readers see whole versions only; a write
    that fails leaves the old one, and a job may read the table it replaces. The
    log also tells what was added after a version. One job writes a table at a time.
    """

    spark: SparkSession
    format: str = "table"
    root: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    table_options: dict[str, dict[str, str]] = field(default_factory=dict)

    def _path(self, name: str) -> str:
        if not self.root:
            raise ValueError(f"a {self.format} store needs a root folder")
        return f"{self.root.rstrip('/')}/{name.replace('.', '/')}"

    def read(self, name: str, **options: str) -> DataFrame:
        """A layer table; ``options`` go to the reader, besides those of the store and the table.

        For JDBC name at least ``partitionColumn``, ``lowerBound``,
        ``upperBound`` and ``numPartitions`` for a large table, or use ``read_in_parts``:
        else one task reads all of it.
        """
        options = {**self.table_options.get(name, {}), **options}
        if self.format == "table":
            return self.spark.read.options(**options).table(name)
        reader = self.spark.read.format(self.format).options(**{**self.options, **options})
        if self.format == "jdbc":
            return reader.option("dbtable", name).load()
        commits = self._commits(name)
        return self._load(name, commits, options) if commits else reader.load(self._path(name))

    def read_in_parts(self, name: str, column: str, parts: int, bins: int = 1000) -> DataFrame:
        """A database table in parts of about equal rows by an integer column, planned from counts that the database makes."""
        if self.format != "jdbc":
            return self.read(name)

        def ask(query: str) -> list:
            return self.spark.read.format("jdbc").options(**self.options).option("query", query).load().collect()

        low, high = ask(splits.range_query(name, column))[0]
        if low is None:
            return self.read(name)
        low, high = int(low), int(high)
        counts = [(int(b), int(n)) for b, n in ask(splits.counts_query(name, column, low, high, bins))]
        predicates = splits.split_predicates(column, splits.split_bounds(low, high, counts, bins, parts))
        options = {**self.options, **self.table_options.get(name, {})}
        for bound in ("partitionColumn", "lowerBound", "upperBound", "numPartitions"):
            options.pop(bound, None)
        url = options.pop("url")
        return self.spark.read.jdbc(url, name, predicates=predicates, properties=options)

    def _commits(self, name: str) -> list:
        """Commits that make up a file table: the last that replaced it, and what was added since."""
        if self.format in ("table", "jdbc"):
            raise ValueError(f"a {self.format} store keeps no versions")
        try:
            rows = self.spark.read.schema(COMMITS).parquet(f"{self._path(name)}/_commits").collect()
        except AnalysisException:
            return []
        rows.sort(key=lambda row: row.version)
        last = max((i for i, row in enumerate(rows) if row.replaces), default=0)
        return rows[last:]

    def _load(self, name: str, commits: list, options: dict[str, str] | None = None) -> DataFrame:
        """The rows of some commits; folders by key are read one by one, as each has such folders of its own."""
        reader = self.spark.read.format(self.format).options(**{**self.options, **(options or {})})
        folders = [f"{self._path(name)}/{row.folder}" for row in commits]
        if any(row.partitioned for row in commits):
            return reduce(DataFrame.unionByName, map(reader.load, folders))
        return reader.load(folders)

    def version(self, name: str) -> int:
        """Number of the last write of a file table, 0 before the first."""
        commits = self._commits(name)
        return commits[-1].version if commits else 0

    def sources(self, name: str) -> dict[str, int]:
        """Versions of the tables that a file table was made from."""
        commits = self._commits(name)
        return dict(commits[-1].sources or {}) if commits else {}

    def added(self, name: str, after: int, until: int | None = None) -> DataFrame | None:
        """Rows that were appended after a version, none if there are no such writes.

        A table that has been replaced since has no such rows: that is an error.
        """
        commits = self._commits(name)
        if commits and commits[0].version > after and after > 0:
            raise ValueError(f"{name} was replaced after version {after}")
        later = [row for row in commits if row.version > after and (until is None or row.version <= until)]
        return self._load(name, later) if later else None

    def vacuum(self, name: str) -> int:
        """Delete the folders of a file table that its present version does not use; their number."""
        kept = {row.folder for row in self._commits(name)}
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self._path(name))
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("v") and f.getPath().getName() not in kept]
        for path in old:
            files.delete(path, True)
        return len(old)

    def write(
        self,
        df: DataFrame,
        name: str,
        mode: str = "overwrite",
        partition_by: Sequence[str] = (),
        sort_by: Sequence[str] = (),
        sources: Sequence[str] | Mapping[str, int] = (),
        **options: str,
    ) -> Observation:
        """Write a layer table; the returned observation holds ``rows``, counted on the way.

        The versions of the tables in ``sources`` are kept with a file table's commit: those given, or what they are now.
        """
        observed = Observation(name)
        df = df.observe(observed, F.count(F.lit(1)).alias("rows"))
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        writer = df.write.mode(mode).options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if self.format == "table":
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.split('.')[0]}")
            writer.saveAsTable(name)
        elif self.format == "jdbc":
            writer.format("jdbc").options(**self.options).option("dbtable", name).save()
        else:
            number = self.version(name) + 1
            made_from = dict(sources) if isinstance(sources, Mapping) else {t: self.version(t) for t in sources}
            folder = f"v{number:08d}-{uuid4().hex[:8]}"
            writer.format(self.format).options(**self.options).save(f"{self._path(name)}/{folder}")
            commit = [(number, folder, mode == "overwrite", bool(partition_by), made_from)]
            rows = self.spark.createDataFrame(commit, COMMITS).coalesce(1)
            rows.write.mode("append").parquet(f"{self._path(name)}/_commits")
        return observed


def sample(df: DataFrame, rows: int = 5) -> DataFrame:
    """A few rows to look at."""
    return df.limit(rows)
