"""Exact duplicates by a tree merge of sorted digest runs.

Every scan task makes one sorted run of its digests.  Runs then move through
binomial rounds: partitions carry a number in base ``fan``, and in round r the
r-th digit of the number is exchanged for the r-th digit of the digest, so that
``fan`` partners swap parts of their runs.  Each partition merges what it gets and
keeps one row per text with its count and its first or last id.  After the last
round the number of a partition is a prefix of its digests.  A text with very many
copies shrinks at every level: no task ever sees more rows of it than partners.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, fold_case, quoted, shuffle_partitions, store

FAN = 8


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, n_bytes, check`` of the case-folded texts (null counts as empty).

    ``digest`` is SHA-256; length and a second hash verify that equal digests
    stand for equal texts.
    """
    text = fold_case(F.coalesce(quoted(text_col), F.lit("")))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), text.alias("text"))
    return rows.select(
        "id",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
    )


def merge_runs(rows: DataFrame, keep: str = "smallest", fan: int = FAN, partitions: int | None = None) -> DataFrame:
    """One row ``digest, n_bytes, check, keep_id, group_size`` per distinct text.

    ``keep`` names which id represents a text, ``"smallest"`` or ``"largest"``;
    null ids count in the size and represent only groups without any other id.
    The number of partitions is a power of ``fan``, at least
    ``spark.sql.shuffle.partitions`` when not given.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    wanted = partitions or shuffle_partitions(rows.sparkSession)
    rounds = 1
    while fan**rounds < wanted:
        rounds += 1
    size = fan**rounds
    run = rows.select(
        F.pmod(F.spark_partition_id(), F.lit(size)).cast("int").alias("slot"),
        "digest", "n_bytes", "check", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
    )
    run = _merged(run, keep)
    # The first four bytes of the digest give the digits of the number it ends in.
    prefix = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(size)).cast("int")
    for level in range(rounds):
        unit = fan**level
        own, new = (F.floor(n / unit) % fan * unit for n in (F.col("slot"), prefix))
        run = run.withColumn("slot", (F.col("slot") - own + new).cast("int"))
        run = _merged(run.repartitionById(size, F.col("slot")), keep)
    return run.drop("slot")


def _merged(run: DataFrame, keep: str) -> DataFrame:
    """The rows of each partition sorted by digest, with equal texts made one row."""
    schema = arrow_schema(run.sparkSession, SCHEMA)
    largest = keep == "largest"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            part = pa.Table.from_batches([batch]).cast(schema)
            table = pa.concat_tables([last, part]) if last is not None else part
            if table.num_rows:
                merged = _combine(table.combine_chunks(), largest)
                # The last text of a batch may go on in the next one.
                yield from merged.slice(0, merged.num_rows - 1).to_batches()
                last = merged.slice(merged.num_rows - 1)
        if last is not None:
            yield from last.to_batches()

    return run.sortWithinPartitions("slot", "digest", "n_bytes", "check").mapInArrow(merge, SCHEMA)


SCHEMA = "slot int, digest binary, n_bytes long, check long, keep_id long, group_size long"


def _combine(table: pa.Table, largest: bool) -> pa.Table:
    """Merge neighbours that agree in slot, digest, length and second hash."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for name in ("slot", "digest", "n_bytes", "check"):
        column = table[name]
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    info = np.iinfo(np.int64)
    ids = table["keep_id"]
    empty = info.min if largest else info.max
    values = pc.fill_null(ids, empty).to_numpy()
    best = (np.maximum if largest else np.minimum).reduceat(values, starts)
    known = np.add.reduceat(ids.is_valid().to_numpy().astype(np.int64), starts) > 0
    first = table.take(pa.array(starts))
    kept = pa.array(best, pa.int64(), mask=~known)
    sizes = pa.array(np.add.reduceat(table["group_size"].to_numpy(), starts))
    return first.set_column(4, table.schema.field(4), kept).set_column(5, table.schema.field(5), sizes)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan: int = FAN
) -> DataFrame:
    """Every document with the one that represents its text.

    Columns ``id, digest, n_bytes, check, keep_id, group_size, kept``.  Texts are
    equal when identical after lower-casing A-Z; null counts as empty.  Rows
    repeated with the same id and text share one decision (all are marked kept);
    ``kept_documents`` leaves one of them.  A null id is kept only where its whole
    group has null ids.  An empty table gives no rows.
    """
    rows, _ = store(digests(docs, id_col, text_col), "digests")
    groups = merge_runs(rows, keep, fan).filter("group_size > 1")
    joined = rows.join(groups, ["digest", "n_bytes", "check"], "left")
    shared = F.col("group_size").isNotNull()
    keep_id = F.when(shared, F.col("keep_id")).otherwise(F.col("id"))
    return joined.select(
        "id", "digest", "n_bytes", "check",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"),
    )


def kept_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan: int = FAN
) -> DataFrame:
    """The documents that stay, one row per text, with all their columns.

    Texts are shuffled once, by id and digest; dropped rows are never built.
    """
    marks = exact_duplicates(docs, id_col, text_col, keep, fan).filter("kept")
    marks = marks.select(F.col("id").alias("_keep_id"), F.col("digest").alias("_keep_digest")).distinct()
    text = fold_case(F.coalesce(quoted(text_col), F.lit("")))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select(
        F.struct(*[quoted(c) for c in docs.columns]).alias("_row"),
        quoted(id_col).cast("long").alias("_id"), digest.alias("_digest"),
    )
    ids = F.coalesce("_id", F.lit(0)), F.col("_id").isNull(), F.col("_digest")
    mark_ids = F.coalesce("_keep_id", F.lit(0)), F.col("_keep_id").isNull(), F.col("_keep_digest")
    left = rows.select("_row", *[c.alias(f"_k{i}") for i, c in enumerate(ids)])
    right = marks.select(*[c.alias(f"_k{i}") for i, c in enumerate(mark_ids)])
    keys = ["_k0", "_k1", "_k2"]
    # Repeated rows meet in the same partition already, so this needs no further shuffle.
    return left.join(right, keys).dropDuplicates(keys).select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
