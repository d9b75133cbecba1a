"""Ingest of tester logs, in one batch or incrementally.

A batch parses its files in parallel, one task a file, numbers runs by windows (no file
waits for another), and recomputes flags for the lots that it touches alone.
``stream`` drives the same step with Structured Streaming: the file source hands every
new log over once, the checkpoint remembers which, and ``foreachBatch`` commits.

A batch first stages what every table will hold for its lots, and its part of the
manifest; then it marks the stage as ready, puts the lots in place and the manifest last.
Each of these writes overwrites, so doing one again changes nothing. A batch that broke
off before the mark is forgotten; one that broke off after it is finished from its stage
before anything else is taken in (``recover``). So a batch counts once, whatever failed
and however often it is tried.

Files that cannot be read are written to the manifest as ``bad`` and do not stop the rest.
"""

from __future__ import annotations

import functools
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silicore.functions.expr import cols, category, decode_efuse, timestamp_from_unix
from silicore.operators.retest import with_exec_seq, with_retest_flag
from silicore.sources.schemas import TABLES, stored
from silicore.sources.store import PARTITIONS, Store, escaped
from silicore.sources.testlog import SCHEMA, parse_files

MANIFEST = "file string, lot_id string, product string, status string, error string, at timestamp"
KEYS = [*cols("product test_category sub_process lot_id")]
RUN = [*KEYS, "wafer_id"]
#: Lots of a batch up to which their names are a filter on the store's folders.
NAMED_LOTS = 10_000


@dataclass
class Ingest:
    """``product`` and ``sub_process``: values for all files; by default the folder before the
    first one that begins with CP, FT or PT names the product, and the log its process."""

    store: Store
    product: str | None = None
    sub_process: str | None = None
    strict: bool = False
    #: Seconds that a log's records may take to walk; a log that takes longer is bad.
    timeout: float | None = 300.0

    # -- manifest

    @property
    def _manifest(self) -> str:
        return f"{self.store.path}/_manifest"

    def manifest(self) -> DataFrame:
        fs, p = self.store._fs(self._manifest)
        spark = self.store.spark
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(self._manifest) if fs.exists(p) else spark.createDataFrame([], MANIFEST)

    def failures(self) -> DataFrame:
        """Files whose last state is bad."""
        w = Window.partitionBy("file").orderBy(F.desc("at"))
        return self.manifest().withColumn("__n", F.row_number().over(w)).where("__n = 1 AND status = 'bad'").drop("__n")

    def pending(self, files: DataFrame, force: bool = False, retry_bad: bool = False) -> DataFrame:
        """The files (path, ...) that were not taken in yet."""
        if force:
            return files
        done = self.manifest()
        if retry_bad:
            done = done.where("status = 'ok'")
        return files.join(done.select(F.col("file").alias("path")).distinct(), "path", "left_anti")

    # -- one batch

    def directory(self, path: str, force: bool = False, retry_bad: bool = False, max_files: int = 1000) -> DataFrame:
        """Take in the logs under ``path`` that the manifest does not have; what was done, a row a file.

        Only names are listed to find them; ``max_files`` logs at a time are then opened
        and committed, so a run that ends early keeps what it finished.
        """
        self.recover()
        spark = self.store.spark
        logs = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        names = logs(path).select("path").where(~F.col("path").rlike("/_corrupt/|/history\\.json$"))
        # The driver lists the files itself, so the names of the new ones fit there. Files of
        # one lot come together and in the order of their time keys.
        plain = lambda p: re.sub(r"([\\{}\[\]*?,])", r"\\\1", p)
        new = [plain(r.path) for r in self.pending(names, force, retry_bad).orderBy(F.element_at(F.split("path", "#"), -1), "path").collect()]
        done = [self.batch(logs(new[i : i + max_files])) for i in range(0, len(new), max_files)]
        return functools.reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], MANIFEST)

    def recover(self) -> None:
        """Finish batches that broke off while they were put in place; forget those that were not ready."""
        fs, p = self.store._fs(f"{self.store.path}/_staging")
        for s in sorted((x.getPath() for x in fs.listStatus(p)), key=str) if fs.exists(p) else []:
            if self._filled(f"{s}/ready"):
                self._put(str(s))
            fs.delete(s, True)

    def batch(self, files: DataFrame) -> DataFrame:
        """Take in ``files``, all of them; what was done, a row a file."""
        self.recover()
        spark = self.store.spark
        stage = f"{self.store.path}/_staging/{uuid.uuid4().hex}"
        parse_files(files, self.strict, self.timeout).write.partitionBy("kind").parquet(f"{stage}/rows")
        rows = spark.read.schema(SCHEMA).parquet(f"{stage}/rows") if self._filled(f"{stage}/rows") else spark.createDataFrame([], SCHEMA)
        self._stage(rows, stage)
        done = self._put(stage)
        fs, p = self.store._fs(stage)
        fs.delete(p, True)
        return done

    def _put(self, stage: str) -> DataFrame:
        """Put a ready stage in place, the manifest last."""
        spark, store = self.store.spark, self.store
        for name in TABLES:
            if self._filled(f"{stage}/ready/{name}"):
                store.replace_lots(name, spark.read.schema(stored(name)).parquet(f"{stage}/ready/{name}"))
        found = spark.read.schema(MANIFEST).parquet(f"{stage}/ready/manifest").collect()  # a row a file of this batch
        out = spark.createDataFrame(found, MANIFEST)
        if found:
            out.coalesce(1).write.mode("overwrite").parquet(f"{self._manifest}/{stage.rsplit('/', 1)[1]}")
        return out

    def _filled(self, path: str) -> bool:
        """Whether there is anything in a folder but marks."""
        fs, p = self.store._fs(path)
        return fs.exists(p) and any(s.isDirectory() or s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p))

    def _stage(self, rows: DataFrame, stage: str) -> None:
        """Write what every table will hold for the lots of ``rows``, and mark the stage as ready."""
        spark, store = self.store.spark, self.store
        lot = rows.where("kind = 'lot'")
        folders = F.split("file", "/")
        at = F.expr("filter(transform(sequence(0, size(__f) - 1), i -> struct(i AS i, __f[i] AS n)), x -> upper(x.n) RLIKE '^(CP|FT|PT)' AND x.i > 0 AND x.i < size(__f) - 1)")
        product = F.lit(self.product) if self.product is not None else F.coalesce(F.expr("__f[__at[0].i - 1]"), F.lit("UNKNOWN"))
        code = F.when(F.coalesce(F.col("test_code"), F.lit("")) == "", "UNKNOWN").otherwise(F.col("test_code"))
        heads = lot.withColumn("__f", folders).withColumn("__at", at).select(
            "file", "lot_id", product.alias("product"), category(code).alias("test_category"), (F.lit(self.sub_process) if self.sub_process is not None else code).alias("sub_process"),
            *cols("part_type job_name job_rev tester_type operator"), timestamp_from_unix("start_t").alias("start_time"), timestamp_from_unix("finish_t").alias("finish_time"),
            F.element_at(F.split(F.element_at(folders, -1), "#"), -1).alias("__ts"),
        )
        # Small: one row a file of this batch.
        heads.write.parquet(f"{stage}/heads")
        heads = spark.read.parquet(f"{stage}/heads")
        head = heads.select("file", *cols("product test_category sub_process __ts"))

        # Runs: one for each wafer that a file measures, numbered after those in the store.
        wafers = rows.where("kind IN ('part', 'test', 'wafer')").select("file", "lot_id", "wafer_id").distinct().join(head, "file")
        touched = head.join(heads.select("file", "lot_id"), "file").select(*KEYS).distinct()
        stored_lots = functools.partial(self._lots, touched=touched)
        old = stored_lots("parts")
        base = wafers.withColumn("__base", F.lit(0).cast("bigint")) if old is None else wafers.join(old.groupBy(*RUN).agg((F.max("retest_num") + 1).alias("__base")), RUN, "left").withColumn("__base", F.coalesce("__base", F.lit(0)))
        order = Window.partitionBy(*RUN).orderBy("__ts", "file")
        runs = base.withColumn("retest_num", (F.col("__base") + F.dense_rank().over(order) - 1).cast("bigint")).drop("__base", "__ts")
        runs.write.parquet(f"{stage}/runs")
        runs = spark.read.parquet(f"{stage}/runs")

        def of(kind: str) -> DataFrame:
            return rows.where(F.col("kind") == kind).join(runs, ["file", "lot_id", "wafer_id"])

        test = with_exec_seq(of("test").withColumn("passed", F.when(F.col("passed"), "P").otherwise("F")), "file", "record_no").withColumn("retest_flag", F.lit(0).cast("bigint"))
        before = stored_lots("test_data")
        if before is not None:
            test = before.unionByName(test.select(*before.columns))
        # Rows of old files without flags keep none and take no part in the ranking.
        flagged = with_retest_flag(test.where("retest_flag IS NOT NULL")).unionByName(test.where("retest_flag IS NULL"))
        last = Window.partitionBy("product", "test_category", "sub_process", "lot_id").orderBy(F.desc("__ts"), F.desc("file"))
        newest = heads.withColumn("__n", F.row_number().over(last)).where("__n = 1")
        decoded = decode_efuse("efuse")
        chips = of("chip").where("test_category = 'FT'").withColumns(decoded).withColumnRenamed("chip_index", "chip_occurrence_index")
        wafer = of("wafer").withColumns({"start_time": timestamp_from_unix("start_t"), "finish_time": timestamp_from_unix("finish_t"), "test_rev": F.lit(""), "source_file": F.element_at(folders, -1)})
        make = f"{stage}/make"
        for name, df in (("test_data", flagged), ("parts", of("part")), ("wafers", wafer), ("chipid", chips), ("lots", newest)):
            df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored(name)])
            if name in ("parts", "wafers", "chipid") and (before := stored_lots(name)) is not None:
                df = before.unionByName(df)
            df.write.parquet(f"{make}/{name}")
        bad = rows.where("kind = 'bad'").select("file", F.lit(None).cast("string").alias("lot_id"), F.lit(None).cast("string").alias("product"), F.lit("bad").alias("status"), "error")
        done = heads.select("file", "lot_id", "product", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(bad).withColumn("at", F.current_timestamp())
        done.coalesce(1).write.parquet(f"{make}/manifest")
        # The stage is ready when this name is there; until then it does not count.
        fs, p = store._fs(make)
        if not fs.rename(p, store._fs(f"{stage}/ready")[1]):
            raise OSError(f"{make} could not be renamed")

    def _lots(self, name: str, touched: DataFrame) -> DataFrame | None:
        """What the store holds of the lots of ``touched``: their folders alone are read."""
        files = self.store.files(name)
        if files is None:
            return None
        want = touched.select(*[escaped(F.col(c)).alias(p) for p, c in PARTITIONS.items()])
        # A batch has max_files logs at most, so its lots are few: their names become a
        # filter on folders. Beyond that the join alone selects.
        names = [r[0] for r in want.select("p_lot").distinct().limit(NAMED_LOTS + 1).collect()]
        if len(names) <= NAMED_LOTS:
            files = files.where(F.col("p_lot").isin(*names))
            want = F.broadcast(want)
        return files.join(want, [*PARTITIONS], "left_semi").select(*stored(name).fieldNames())

    # -- increments

    def stream(self, path: str, checkpoint: str, glob: str = "*", max_files: int = 1000):
        """Take in every log that appears under ``path`` once; returns when none is left.

        A batch holds ``max_files`` logs at most, so a backlog of any length is worked
        off in steps that fit.
        """
        spark = self.store.spark
        source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)

        def step(df: DataFrame, _: int) -> None:
            self.recover()
            self.batch(self.pending(df))

        query = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
