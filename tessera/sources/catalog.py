"""Tables by name: explicit schemas, Parquet scans, date normalisation, derived partsupp."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"I": T.IntegerType, "L": T.LongType, "D": T.DoubleType, "S": T.StringType, "T": T.TimestampNTZType}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k](), True) for n, k in (c.split(":") for c in text.split())])


# Column names and types of the star schema's Parquet files.
SCHEMAS: dict[str, T.StructType] = {
    "region": _schema("r_regionkey:I r_name:S"),
    "nation": _schema("n_nationkey:I n_name:S n_regionkey:I"),
    "customer": _schema("c_custkey:L c_name:S c_nationkey:I c_acctbal:D c_mktsegment:S"),
    "supplier": _schema("s_suppkey:L s_name:S s_nationkey:I s_acctbal:D"),
    "part": _schema("p_partkey:L p_name:S p_brand:S p_type:S p_size:I p_retailprice:D"),
    "orders": _schema("o_orderkey:L o_custkey:L o_orderstatus:S o_totalprice:D o_orderdate:T o_orderpriority:S"),
    "lineitem": _schema(
        "l_orderkey:L l_partkey:L l_suppkey:L l_linenumber:I l_quantity:D l_extendedprice:D "
        "l_discount:D l_tax:D l_returnflag:S l_linestatus:S l_shipdate:T"
    ),
}
DERIVED = ("partsupp",)


class Catalog:
    """Reads `base/{table}.parquet`; a table not in SCHEMAS is read with its own schema."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def scan(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        if name in DERIVED:
            df = self._partsupp()
        else:
            reader = self.spark.read
            if name in SCHEMAS:
                reader = reader.schema(SCHEMAS[name])
            df = reader.parquet(f"{self.base}/{name}.parquet")
        if columns is not None:
            missing = [c for c in columns if c not in df.columns]
            if missing:
                raise KeyError(f"{name} has no column {missing}")
            df = df.select(*columns)
        return df

    def dates(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        """As scan(), with midnight timestamps as dates."""
        df = self.scan(name, columns)
        return df.withColumns({f.name: F.col(f.name).cast("date") for f in df.schema if f.dataType == T.TimestampNTZType()})

    def register(self, names: Iterable[str] = (*SCHEMAS, *DERIVED)) -> None:
        for n in names:
            self.scan(n).createOrReplaceTempView(n)

    def _partsupp(self) -> DataFrame:
        return (
            self.scan("lineitem", ["l_partkey", "l_suppkey", "l_extendedprice"])
            .groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
            .agg(F.max("l_extendedprice").alias("ps_supplycost"))
        )
