"""The query table and the loader of input tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ...sources.readers import spread

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Input tables by attribute, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    @property
    def texts(self) -> DataFrame:
        """Documents spread over all cores, for work that is costly per text."""
        return spread(self.documents, "doc_id")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated builder under its own name."""

    def add(build: Callable[[Tables], DataFrame]):
        REGISTRY[name or build.__name__] = (build, sql)
        return build

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def p_sql(t: str, freedom: str, steps: int = 2_000) -> str:
    """Two-sided p value of Student's t in SQL: Simpson's rule on cos(angle)^(freedom - 1)."""
    weight = f"case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end"
    angle = f"atan(abs({t}) / sqrt({freedom}))"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(cos(i * {angle} / {steps}), ({freedom}) - 1)))"
    norm = f"exp(lgamma((({freedom}) + 1) / 2.0) - lgamma(({freedom}) / 2.0)) / sqrt(pi())"
    return f"round(greatest(1 - 2 * {norm} * {area} * {angle} / {3 * steps}, 0), 6)"
