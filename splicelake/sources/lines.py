"""Line order of text inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_order() -> Column:
    """Sortable position of a row: file, split start, row inside the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
