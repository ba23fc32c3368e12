"""Table readers, schema-checked table writer and the restricted customer view."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("cpf", T.StringType(), False),
    T.StructField("phone", T.StringType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("tier", T.StringType(), False),
    T.StructField("signup_date", T.DateType(), False),
])
ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("total_value", T.DecimalType(10, 2), False),
    T.StructField("payment_method", T.StringType(), False),
    T.StructField("carrier", T.StringType(), False),
    T.StructField("estimated_delivery", T.DateType(), False),
    T.StructField("delivered_at", T.DateType(), True),
])
TICKETS = T.StructType([
    T.StructField("ticket_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("order_id", T.LongType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("subject", T.StringType(), False),
    T.StructField("body", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("resolution_hours", T.DoubleType(), True),
    T.StructField("csat", T.IntegerType(), True),
])
SCHEMAS = {"customers": CUSTOMERS, "orders": ORDERS, "tickets": TICKETS}
SAFE_CUSTOMER_COLUMNS = ["customer_id", "state", "tier", "signup_date"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A whole parquet table, ``folder/name.parquet`` (a file or a directory of files)."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def write_table(df: DataFrame, path: str, schema: T.StructType, mode: str = "append") -> None:
    """Write ``df`` with exactly the declared columns and types. A missing column or a value that
    does not fit its declared type fails the write (ANSI casts) instead of becoming NULL."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    required = [f.name for f in schema.fields if not f.nullable]
    checked = df.select(*columns)
    for name in required:
        present = F.when(F.col(name).isNull(), F.raise_error(F.lit(f"NULL in {name}")))
        checked = checked.withColumn(name, present.otherwise(F.col(name)))
    checked.write.mode(mode).parquet(path)


def load_tables(frames: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Parents first: customers, orders, tickets."""
    for name, schema in SCHEMAS.items():
        write_table(frames[name], os.path.join(folder, f"{name}.parquet"), schema, mode)


def safe_customer_view(customers: DataFrame, view: str | None = None) -> DataFrame:
    """The customer columns that are free of personal data, and no others; registered as a temp view
    when named. A source without one of them, such as a date, gives the rest."""
    safe = customers.select(*[c for c in SAFE_CUSTOMER_COLUMNS if c in customers.columns])
    if view:
        safe.createOrReplaceTempView(view)
    return safe
