from pathlib import Path

import pytest


@pytest.fixture()
def rows(spark, tmp_path):
    """A function that makes a DataFrame from a dict of lists and a schema string."""
    def make(schema: str, data: list[tuple]):
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture()
def as_table(spark, tmp_path):
    """Writes a DataFrame as ``<folder>/<name>.parquet`` and returns the folder."""
    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(Path(tmp_path) / f"{name}.parquet"))
        return str(tmp_path)

    return write
