"""Small configuration tables brought next to the data without a join."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_config(df: DataFrame, entries: list[dict], schema: str) -> DataFrame:
    """Every row once per entry, with the entry's fields as columns.

    The entries travel inside the plan as one literal; nothing is joined or shuffled.
    """
    parsed = F.from_json(F.lit(json.dumps(entries)), f"array<struct<{schema}>>")
    return df.withColumn("_entry", F.explode(parsed)).select(*df.columns, "_entry.*")
