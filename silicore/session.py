"""A session over one store: SQL with parameters, and the tables as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from silicore.operators import analysis
from silicore.plans.views import Model
from silicore.sources.store import Store


def spark_session(name: str = "silicore") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.sources.partitionColumnTypeInference.enabled", "false").getOrCreate()


def numbered_parameters(sql: str) -> str:
    """``$1`` as ``:p1``, but not within quotes, quoted names and comments."""
    part = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$(\d+)""", re.S)
    return part.sub(lambda m: f":p{m[1]}" if m[1] else m[0], sql)


class Session:
    """Views live in a session of their own; ``with`` or ``close`` drops them."""

    def __init__(self, store: Store) -> None:
        self.store = Store(store.spark.newSession(), store.path, store.gross_die, store.compression)
        self.spark = self.store.spark
        self.model: Model = self.store.model()
        self.views = self.model.register()
        self.kept: list[DataFrame] = []

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for v in self.views:
            self.spark.catalog.dropTempView(v)
        for df in self.kept:
            df.unpersist()

    def q(self, sql: str, params: Sequence | dict | None = None) -> DataFrame:
        """``params``: a list for ``?`` or ``$1``, ``$2``, ... (each as often as it is named), or a dict for ``:name``."""
        if not params:
            return self.spark.sql(sql)
        if not isinstance(params, dict) and (numbered := numbered_parameters(sql)) != sql:
            return self.spark.sql(numbered, args={f"p{i}": v for i, v in enumerate(params, 1)})
        return self.spark.sql(sql, args=params)

    def rows(self, sql: str, params: Sequence | dict | None = None) -> list[dict]:
        return [r.asDict() for r in self.q(sql, params).collect()]

    def lots(self, *filters: str | None) -> DataFrame:
        """Lots, newest first; filters: product, then test category."""
        return analysis.session_lots(self.model, *filters)

    def use(self, table: str, lot: str | None = None) -> DataFrame:
        """Keep a table, or one lot of it, in memory and put it in the view's place."""
        df = getattr(self.model, table)
        df = df if lot is None else df.where(df["lot_id"] == lot)
        df = df.cache()
        self.kept.append(df)
        df.createOrReplaceTempView(table)
        return df
