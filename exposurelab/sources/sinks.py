"""Writers and the write-once, read-back checkpoint."""

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .readers import file_versions


def has_success(df: DataFrame, path: str) -> bool:
    """A finished write left its marker file in the folder."""
    jvm = df.sparkSession._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return marker.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(marker)


def materialize(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write once, always read back.

    A finished result at ``path`` is reused; an unfinished one has no marker and
    is written again.  Reading back cuts the lineage.
    """
    if overwrite or not has_success(df, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Hidden from readers of the folder, as are all names that begin with an underscore.
MANIFEST = "_manifest.json"


def plan_digest(df: DataFrame) -> str:
    """Digest of what a frame computes: its analysed plan and the versions of the files it reads.

    Numbers of expressions differ between runs and are left out, and so are files
    below the shared scratch folder, whose names do.  Rows that came from the
    driver are known by their schema only.
    """
    spark = df.sparkSession
    setting = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(2**31 - 1))
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(setting, before)
    plan = re.sub(r"#\d+L?|plan_id=\d+", "#", plan)
    scratch = shared_dir(spark).rstrip("/") + "/"
    files = [f for f in file_versions(df) if scratch not in f[0]]
    return hashlib.sha256(json.dumps([plan, files]).encode()).hexdigest()


def manifest_of(df: DataFrame) -> dict:
    return {"version": 1, "schema": json.loads(df.schema.json()), "plan": plan_digest(df)}


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFEST}")
    if not name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name):
        return None
    stream = name.getFileSystem(spark._jsc.hadoopConfiguration()).open(name)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def checkpoint_table(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """``materialize`` that knows what it wrote.

    A manifest with the schema and the digest of the plan is written last.  A
    table is reused only if its manifest says that the same plan on the same files
    made it.  Without a success marker a write was broken off and is done again.
    A finished table of another schema, plan or input, or without a manifest,
    raises ValueError and stays as it is.
    """
    spark, wanted = df.sparkSession, manifest_of(df)
    if not overwrite and has_success(df, path):
        found = read_manifest(spark, path)
        if found is None:
            raise ValueError(f"the table at {path} has no manifest; choose another path or overwrite it")
        wrong = [k for k in wanted if found.get(k) != wanted[k]]
        if wrong:
            raise ValueError(f"the table at {path} was made with another {', '.join(wrong)}; choose another path or overwrite it")
    else:
        df.write.mode("overwrite").parquet(path)
        name = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFEST}")
        out = name.getFileSystem(spark._jsc.hadoopConfiguration()).create(name, True)
        out.write(bytearray(json.dumps(wanted).encode()))
        out.close()
    return spark.read.schema(df.schema).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table of this run that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


# ISO timestamps down to the microsecond (the default stops at milliseconds).
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
ISO_NO_ZONE = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines, a file per task; timestamps as ISO text."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("timestampFormat", ISO).option("timestampNTZFormat", ISO_NO_ZONE).json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option(
        "escape", '"'
    ).csv(path)


# The most members of a list; of a key with more, lists are dealt half full so that none exceeds it.
LIST_SIZE = 10_000


def collect_lists(pairs: DataFrame, key: str, member: str, parts: int = 1, size: int = LIST_SIZE) -> DataFrame:
    """Distinct members per key as sorted lists, ``parts`` of them for every key with as many members.

    A key with more than ``parts * size`` members gets as many lists of about half of
    ``size`` as it needs, so no list grows with the data.  The layout of a key
    follows from its own members: they are dealt out by their hash.
    """
    unique = pairs.select(F.col(key).alias("_key"), F.col(member).alias("_member")).dropna().distinct()
    counts = unique.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > parts * size)
    # At most one row per ``size`` pairs.
    long = counts.select("_key", F.ceil(2 * F.col("_n") / size).alias("_parts"))
    part = F.pmod(F.xxhash64("_member"), F.coalesce("_parts", F.lit(parts).cast("long"))).alias("part")
    dealt = unique.join(F.broadcast(long), "_key", "left").select(F.col("_key").alias(key), part, "_member")
    return dealt.groupBy(key, "part").agg(F.sort_array(F.collect_list("_member")).alias("members"))


def write_map(pairs: DataFrame, key: str, member: str, path: str, parts: int = 1) -> None:
    """Map documents ``{key: [members]}``, one JSON object per line and part of a key."""
    lists = collect_lists(pairs, key, member, parts)
    line = F.to_json(F.create_map(F.col(key).cast("string"), F.col("members")))
    lists.select(line.alias("value")).write.text(path)
