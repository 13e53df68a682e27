"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """rows as they are now: a table in the folder that spark.checkpoint.dir names, which outlives executors.

    A table and no checkpoint, as that would take along the plan's constraints,
    which Catalyst can take minutes to infer.

    A local session, which is one process, may go without the setting and gets
    a temporary folder.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", context.getConf().get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    path = f"{context.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
