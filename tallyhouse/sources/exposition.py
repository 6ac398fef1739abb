"""Text renderings of results: Prometheus gauges, JSON lines, Markdown rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prometheus(snapshot: DataFrame, prefix: str, *labels: str) -> DataFrame:
    """line: one gauge sample for each number of the snapshot; nulls have no sample."""
    numbers = [c for c, kind in snapshot.dtypes if c not in labels and kind.split("(")[0] in ("int", "bigint", "double", "decimal", "boolean")]
    samples = F.array(*[F.struct(F.lit(f"{prefix}_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), F.regexp_replace(F.regexp_replace(F.col(k).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')) for k in labels])
    told = F.when(shown != "", F.concat(F.lit("{"), shown, F.lit("}"))).otherwise("")
    rows = snapshot.select(told.alias("labels"), F.explode(samples).alias("s")).where("s.value is not null")
    return rows.select(F.format_string("%s%s %s", "s.metric", "labels", F.col("s.value").cast("string")).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))


def markdown(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("line"))


def tsv(df: DataFrame) -> DataFrame:
    """Tab-separated rows; tabs and line ends inside values become spaces, nulls are empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " "), F.lit("")) for c in df.columns]).alias("line"))


def aligned(df: DataFrame) -> DataFrame:
    """place (0: heads, 1: rules, 2: rows) and line: columns as wide as their longest value, two spaces apart, heads in capitals."""
    told = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    wide = told.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(f"w_{c}") for c in df.columns])
    rows = told.crossJoin(F.broadcast(wide))

    def line(values: dict) -> list:
        return [F.rpad(v, F.col(f"w_{c}"), " ") for c, v in values.items()]

    body = rows.select(F.lit(2).alias("place"), F.concat_ws("  ", *line({c: F.col(c) for c in df.columns})).alias("line"))
    heads = wide.select(F.lit(0).alias("place"), F.concat_ws("  ", *line({c: F.lit(c.upper()) for c in df.columns})).alias("line"))
    rules = wide.select(F.lit(1).alias("place"), F.concat_ws("  ", *[F.repeat(F.lit("-"), F.col(f"w_{c}")) for c in df.columns]).alias("line"))
    return heads.unionByName(rules).unionByName(body)


def stale(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that a stored view lacks or has too many: empty if it is up to date."""
    return computed.exceptAll(stored).withColumn("change", F.lit("missing")).unionByName(stored.exceptAll(computed).withColumn("change", F.lit("unexpected")))
