"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# How a delimited survey file writes its cells.
DELIMITED = {"header": True, "sep": ",", "quote": '"', "escape": '"', "nullValue": "NA"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   multi_line: bool = False, strict: bool = True) -> DataFrame:
    """Read a delimited file with a header.

    A cell that does not fit the schema, or a row of the wrong length, is an
    error; with ``strict=False`` such cells become missing.

    Give the schema: inferring one reads the whole file a first time.
    ``multi_line`` is needed only where quoted cells hold line breaks; it stops
    Spark from splitting a file.
    """
    reader = spark.read.options(**DELIMITED, emptyValue="").option("multiLine", multi_line)
    reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_delimited(df: DataFrame, path: str) -> None:
    """Write a delimited file with a header and no row numbers.

    Cells with separators or quotes, such as ``[10,000, 15,000)``, are quoted.
    A missing cell is written as ``NA`` and empty text as ``""``, so both are
    read back as they were; the text ``NA`` itself is read as missing.
    """
    df.write.options(**DELIMITED, emptyValue='""').csv(path)


def ingest(reader: Callable[[], DataFrame], path: str) -> DataFrame:
    """Convert any Spark-readable source to Parquet once and return that table."""
    source = reader()
    source.write.parquet(path)
    return source.sparkSession.read.schema(source.schema).parquet(path)


# A separator that no open quote covers.
OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def ingest_delimited(spark: SparkSession, source: str, schema: StructType, path: str,
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Convert a delimited file to Parquet: the rows that fit the schema, and those that do not.

    Both are written below ``path`` in one scan, so a bad row neither stops the
    ingestion nor turns silently into missing cells.  The second table has the
    ``file``, the ``line`` as it stands there and the ``reason``: the number of cells,
    or the first column whose cell is not of its type.
    """
    whole = StructType([*schema.fields, StructField("_line", StringType())])
    options = {**DELIMITED, "emptyValue": "", "header": header}
    rows = (spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_line").schema(whole).csv(source)
            .withColumn("_file", F.col("_metadata.file_path")))
    rows.withColumn("_bad", F.col("_line").isNotNull()).write.partitionBy("_bad").parquet(path)
    kept = StructType([*whole.fields, StructField("_file", StringType())])
    written = spark.read.schema(kept.add("_bad", "boolean")).parquet(path)
    bad = written.where("_bad").select(F.col("_file").alias("file"), F.col("_line").alias("line"))
    return written.where("not _bad").select(*schema.names), bad.withColumn("reason", _why(schema))


def _why(schema: StructType) -> Column:
    names = [f"c{i}" for i in range(len(schema))]
    cells = F.from_csv("line", F.lit(", ".join(f"{n} string" for n in names)), {k: str(v).lower() if k == "header" else v for k, v in DELIMITED.items()})
    count = F.size(F.split("line", OUTSIDE_QUOTES, -1))
    misfits = [F.when(cells[n].isNotNull() & cells[n].try_cast(field.dataType).isNull(),
                      F.lit(f"{field.name}: not of type {field.dataType.simpleString()}")) for n, field in zip(names, schema.fields)]
    return F.when(count != len(schema), F.concat(count.cast("string"), F.lit(f" cells for {len(schema)} columns"))).otherwise(
        F.coalesce(*misfits, F.lit("cannot be read")))
