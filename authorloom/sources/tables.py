"""CSV and parquet tables with fixed schemas and column orders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from authorloom.operators.merge import last_per_id
from authorloom.schemas import AUTHOR_PREDICTIONS, CONTENT, FLAGS, PREDICTION_ROWS, RESULT, USERS
from authorloom.sources.committed import CommittedTable
from authorloom.sources.quoted_csv import read_quoted

# Spellings that count as true in a CSV file.
TRUE_TEXT = "true"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ssXXX"


def _csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """CSV with quoted fields as text, and ``_order``, the place of each row; ``multi_line`` allows line breaks
    inside fields, and large files are read by many tasks all the same."""
    if multi_line:
        return read_quoted(spark, path, schema.names)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(text).csv(path)
    order = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    return rows.select("*", order.alias("_order"))


def _typed(raw: DataFrame, schema: T.StructType) -> list:
    columns = []
    for field in schema:
        value = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            value = F.coalesce(F.lower(value) == TRUE_TEXT, F.lit(False))
        elif isinstance(field.dataType, T.TimestampType):
            value = F.coalesce(
                F.try_to_timestamp(value, F.lit(TIMESTAMP_FORMAT)), F.try_to_timestamp(value)
            )
        else:
            value = value.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return columns


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as its files are; Spark splits large ones by row group."""
    return spark.read.parquet(path)


def read_table_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """Typed table without an inference pass; empty cells are NULL."""
    raw = _csv(spark, path, schema, multi_line)
    return raw.select(*_typed(raw, schema))


def read_keyed_csv(
    spark: SparkSession, path: str, schema: T.StructType, id_col: str = "id", multi_line: bool = True
) -> DataFrame:
    """One row per id, the last in file order; no rows if the path does not exist."""
    try:
        raw = _csv(spark, path, schema, multi_line)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = raw.select(*_typed(raw, schema), "_order")
    return last_per_id(rows, "_order", id_col).select(*schema.names)


def _write(df: DataFrame, path: str, columns: list[str], fmt: str, mode: str) -> None:
    writer = df.select(*columns).write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').option(
            "timestampFormat", TIMESTAMP_FORMAT
        ).option("emptyValue", "").csv(path)
    else:
        writer.format(fmt).save(path)


def write_users(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite the users table: fixed columns first, then any statistics."""
    extra = [c for c in df.columns if c not in USERS.names]
    _write(df, path, [*USERS.names, *extra], fmt, "overwrite")


def write_content(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite the content table: fixed columns first, then any counts."""
    extra = [c for c in df.columns if c not in CONTENT.names]
    _write(df, path, [*CONTENT.names, *extra], fmt, "overwrite")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save as a table bucketed and sorted by a key.

    Users and content saved with the same number of buckets join by author without
    moving the text again; every comparison and experiment starts with that join.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.format("parquet").saveAsTable(table)


def append_rows(df: DataFrame, path: str, kind: str, fmt: str = "parquet") -> None:
    """Append users or content in the fixed column order."""
    columns = USERS.names if kind == "user" else CONTENT.names
    _write(df, path, columns, fmt, "append")


def write_flag_list(df: DataFrame, path: str) -> None:
    _write(df, path, FLAGS.names, "csv", "overwrite")


def read_flag_list(spark: SparkSession, path: str) -> DataFrame:
    """Flagged images; no rows if there is no list."""
    try:
        return read_table_csv(spark, path, FLAGS, multi_line=False)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FLAGS)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Author predictions, one folder per experiment and dataset."""
    columns = ["experiment_name", *AUTHOR_PREDICTIONS]
    writer = df.select(*columns).write.mode("overwrite").partitionBy("experiment_name", "dataset")
    writer.option("header", True).format(fmt).save(path)


def append_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append experiment rows in the fixed 17-column order."""
    _write(df, path, RESULT.names, fmt, "append")


def _committed(spark: SparkSession, path: str, columns: T.StructType, cut: tuple[str, ...] = ()) -> CommittedTable:
    return CommittedTable(spark, path, columns, cut)


def commit_rows(df: DataFrame, path: str, kind: str, commit: int | str) -> bool:
    """Append users or content under an id: a rerun with the same id adds nothing, a lost one leaves nothing."""
    return _committed(df.sparkSession, path, USERS if kind == "user" else CONTENT).commit(df, commit)


def committed_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Users or content of all commits; no rows if there are none."""
    return _committed(spark, path, USERS if kind == "user" else CONTENT).read()


def commit_predictions(df: DataFrame, path: str, run: str) -> bool:
    """Author predictions of a run, once, in one folder per experiment and dataset."""
    return _committed(df.sparkSession, path, PREDICTION_ROWS, ("experiment_name", "dataset")).commit(df, run)


def committed_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _committed(spark, path, PREDICTION_ROWS, ("experiment_name", "dataset")).read()


def commit_result(df: DataFrame, path: str, run: str) -> bool:
    """Experiment rows of a run, once, in the fixed 17-column order."""
    return _committed(df.sparkSession, path, RESULT).commit(df, run)


def committed_results(spark: SparkSession, path: str) -> DataFrame:
    return _committed(spark, path, RESULT).read()
