"""Table definitions as DDL, and putting rows into their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEMAND = """
region STRING NOT NULL, sku STRING NOT NULL, date DATE NOT NULL, product_id STRING NOT NULL, demand INT NOT NULL,
price DOUBLE NOT NULL, day_of_week INT NOT NULL, promotion BOOLEAN NOT NULL, inventory INT NOT NULL
"""

RUN_PLAN_KEYS = "region STRING NOT NULL, sku STRING NOT NULL, model_name STRING NOT NULL"

TELEMETRY = """
region STRING COMMENT 'Sales region',
sku STRING COMMENT 'Article number',
model_name STRING COMMENT 'Which of the models of the article',
rmse DOUBLE COMMENT 'Root of the mean squared holdout error; empty without holdout rows',
mape DOUBLE COMMENT 'Mean holdout error as a share of demand',
r2 DOUBLE COMMENT 'Explained share of the holdout variance; empty where demand does not vary',
params MAP<STRING, STRING> COMMENT 'Settings and coefficients by name',
metrics MAP<STRING, DOUBLE> COMMENT 'Every metric by name',
logged_at TIMESTAMP COMMENT 'Start of the load that wrote the row'
"""


def columns_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Declared columns, in declared order, cast to their declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns_of(ddl)])


def null_violations(df: DataFrame, ddl: str) -> DataFrame:
    """One row per required column with the number of rows that miss it: one pass, no row leaves its task."""
    required = [f.name for f in columns_of(ddl) if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in required]
    return counts.select(F.inline(F.array(*pairs)))
