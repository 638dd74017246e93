"""The key dimension: what the company names of a run go by, made once and shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import ALIASES, Aliases, Names, keyed_names
from ledgerloom.operators.components import stage


def company_names(*columns: DataFrame, aliases: Aliases = None) -> Names:
    """The key dimension of one-column frames; hand the result to operators in place of aliases.

    By a frame of aliases, names, null as blank, are keyed once and written: the table holds each name once however many rows
    have it, so only names are folded and matched. Operators join it; names that are in none of the columns would be lost
    there, so all tables of a run are to be given. By fixed aliases rows are keyed where they stand, and there is no table.
    """
    if isinstance(aliases, Names) or not isinstance(aliases, DataFrame):
        return aliases if isinstance(aliases, Names) else Names(None, aliases)
    every = reduce(DataFrame.unionByName, (c.select(F.coalesce(F.col(c.columns[0]), F.lit("")).alias("_name")) for c in columns)).distinct()
    return Names(stage(keyed_names(every, aliases).withColumnRenamed("_name", "name"), "names"), aliases)


def alias_rows(spark: SparkSession, aliases: Aliases) -> DataFrame:
    """(row_idx, alias, company) of aliases in their order; a frame's order is its row_idx, if it has one, else its spelling."""
    given = aliases.aliases if isinstance(aliases, Names) else aliases
    if isinstance(given, DataFrame):
        at = F.col("row_idx").cast("long") if "row_idx" in given.columns else F.lit(0).cast("long")
        return given.select(at.alias("row_idx"), F.col("alias"), F.trim("canonical").alias("company"))
    rows = [(i, a, c) for i, (a, c) in enumerate((ALIASES if given is None else given).items())]
    return spark.createDataFrame(rows, "row_idx long, alias string, company string")
