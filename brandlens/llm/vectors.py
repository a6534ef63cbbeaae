"""What the vector searches share: which vectors take part, and blocks of queries and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.llm.spark_files import with_checkpoint_dir

#: Rows and queries of a block; a task meets them some queries at a time.
BLOCK_ROWS, BLOCK_QUERIES, AT_ONCE = 8192, 4096, 256


def usable_vectors(rows: DataFrame) -> DataFrame:
    """row_id, vec_id and vector (array<double>) of the rows that take part; row_id tells rows of one vec_id apart.

    Rows with a null id, with a null or empty vector, or with a null or non-finite component take no part. The result is a
    checkpoint, so that row_id stays the same however often it is read.
    """
    with_checkpoint_dir(rows.sparkSession)
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)
    return usable.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "vector").checkpoint()


def with_row_id(rows: DataFrame, id_col: str) -> DataFrame:
    """row_id, ``id_col`` and vector; without a column row_id the ids are taken to be unique."""
    return rows.select(F.col("row_id" if "row_id" in rows.columns else id_col).cast("bigint").alias("row_id"), id_col, "vector")


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).reshape(len(column), dims) if len(column) else np.zeros((0, dims))
