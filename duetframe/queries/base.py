"""How queries are registered: a name, a function of relations, and DuckDB SQL over the same relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.projections import prelude, relation, with_condition

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Tables:
    """The relations over a folder of tables; those with treatments hold them as a map, as the log does."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        df = relation(self.spark, self.sf_dir, name)
        return with_condition(df) if name in ("dyads", "survey_dyads", "manifest") else df

    def flat(self, name: str) -> DataFrame:
        return relation(self.spark, self.sf_dir, name)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places, so that the order of summation cannot show."""
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


class Registry:
    """Queries in the order in which they were added."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, needs: str, sql: str | None, recursive: bool = False):
        """Register a function of Tables; ``sql`` follows a WITH clause of the relations it ``needs`` (its own start with a comma)."""
        def register(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
            if sql is not None:
                self.sql[name] = f"{prelude(*needs.split(), recursive=recursive)}\n{sql}"
            return f

        return register
