"""Helpers shared by the operators: stored intermediate tables and text columns."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The only letters that the digests and words fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Bytes that belong to no term become blanks, A-Z lower case.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII, with A-Z in lower case."""
    return text.translate(FOLDED).split()


def fold_case(text: Column) -> Column:
    """A-Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns ``id`` and ``text`` alone; null texts become empty."""
    return df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write rows to the shared folder and read them back; also returns the path.

    The copy outlives lost executors and is computed once however often it is read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables of this run that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def map_rows(df: DataFrame, function: Callable[[list[tuple]], list[tuple]], schema: str, batch: int = 512) -> DataFrame:
    """Rows through a function of a list of rows, batch by batch inside each task."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                columns = [part.column(n).to_pylist() for n in names]
                made = function(list(zip(*columns)))
                if made:
                    yield to_batch(made, target)

    target = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
