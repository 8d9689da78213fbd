"""Helpers that the operators of this package share."""

from __future__ import annotations

import importlib.util
import math
import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lectern.session import save_once

TOKENIZER_DIR = "/opt/tokenizers"


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file.

    Without a folder the installed package of vocabulary files says where they are.
    """
    if folder is None and importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder or TOKENIZER_DIR, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding them."""
    return pc.cast(column, pa.binary()).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save_stage(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder; its shuffle files go once it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return save_once(df, name)
    finally:
        conf.set(_CLEANUP, before)
