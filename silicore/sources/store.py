"""The Parquet store: one folder a table, partitioned by product, category, process and lot.

The partition columns (``p_*``) hold the run's keys as text, nulls, empty values and a
leading underscore escaped, so the keys follow from them without loss: the model's key
columns are expressions over the partition columns, and a report's filter or join on a lot
or product prunes folders, whatever the report. The keys also lie in the files, for
other readers. Reads take the tables' explicit schema: columns that old files lack are
null, and no footers are sampled.

One writer at a time. A batch's tables are staged, then each is put in place lot by lot,
which gives the same tables however often it is done (see ``streaming.ingest``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from silicore.plans.views import Model, gross_die_table
from silicore.sources.schemas import TABLES, stored

PARTITIONS = {"p_product": "product", "p_category": "test_category", "p_process": "sub_process", "p_lot": "lot_id"}


def escaped(key: Column) -> Column:
    """A key as the name of a folder: never null or empty."""
    return F.when(key.isNull(), "_null").when(key == "", "_empty").when(key.startswith("_"), F.concat(F.lit("_"), key)).otherwise(key)


def unescaped(name: Column) -> Column:
    return F.when(name == "_null", None).when(name == "_empty", "").when(name.startswith("_"), F.substring(name, 2, 1 << 30)).otherwise(name)


def with_partitions(df: DataFrame) -> DataFrame:
    return df.withColumns({p: escaped(F.col(c)) for p, c in PARTITIONS.items()})


class Store:
    def __init__(self, spark: SparkSession, path: str, gross_die: Mapping[str, tuple[int, int]] | None = None, compression: str = "zstd") -> None:
        self.spark, self.path, self.gross_die, self.compression = spark, path.rstrip("/"), dict(gross_die or {}), compression

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def has(self, table: str) -> bool:
        fs, p = self._fs(f"{self.path}/{table}")
        return fs.exists(p)

    def table(self, name: str) -> DataFrame | None:
        """The stored table, its keys read from the partition columns; None where there is none yet."""
        files = self.files(name)
        if files is None:
            return None
        keys = {c: unescaped(F.col(p)).alias(c) for p, c in PARTITIONS.items()}
        return files.select(*[keys.get(c, F.col(c)) for c in stored(name).fieldNames()])

    def files(self, name: str) -> DataFrame | None:
        """The stored table as it lies, with its partition columns."""
        if not self.has(name):
            return None
        schema = StructType(stored(name).fields)
        for p in PARTITIONS:
            schema = schema.add(p, "string")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def model(self) -> Model:
        return Model(**{n: self.table(n) for n in TABLES}, gross_die=gross_die_table(self.spark, self.gross_die))

    def replace_lots(self, name: str, df: DataFrame) -> None:
        """Write ``df`` in place of what its lots' partitions held; other lots stay."""
        cols = stored(name).fieldNames()
        out = with_partitions(df.select(*[F.col(c).cast(stored(name)[c].dataType) if c in df.columns else F.lit(None).cast(stored(name)[c].dataType).alias(c) for c in cols]))
        # Lots are gathered, and lots that are too large for one task are split.
        out = out.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", self.compression).partitionBy(*PARTITIONS).parquet(f"{self.path}/{name}")


def import_tree(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table from a tree laid out as ``product=/test_category=/sub_process=/lot_id=/...``,
    whose path columns may be empty, ragged or numeric: they are read from the path as text."""
    files = spark.read.schema(stored(table)).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/{table}")
    name = F.col("_metadata.file_path")
    part = lambda k: F.url_decode(F.regexp_extract(name, rf"/{k}=([^/]*)/", 1))
    known = {"product": "product", "test_category": "test_category", "sub_process": "sub_process"}
    return files.withColumns({c: F.coalesce(F.col(c), part(k)) for k, c in known.items()})
