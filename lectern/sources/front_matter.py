"""Front-mattered documents: file scan, parsing and value coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE, enforce, first_error, guarded
from lectern.functions.text import BLANKS, strip, universal_newlines

# The six declared keys of a stimulus file and their types.
KNOWN_KEYS = {
    "stimulus_id": "string",
    "unit_id": "string",
    "condition": "string",
    "variant": "string",
    "example_count": "bigint",
    "learner_error_scripted": "boolean",
}

_DELIMITER_LINE = rf"(?dm)^[{BLANKS}]*---[{BLANKS}]*$"
_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files as ``(path, content)``; globs and several paths are allowed."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def _entries(block: Column) -> Column:
    """Stripped ``(key, value)`` pairs of a block's non-blank lines, split at the first colon."""
    lines = F.filter(F.split(block, "\n"), lambda line: strip(line) != "")
    return F.transform(
        lines,
        lambda line: F.struct(
            strip(F.substring_index(line, ":", 1)).alias("key"),
            strip(F.regexp_replace(line, r"\A[^:]*:?", "")).alias("value"),
        ),
    )


def _last_per_key(entries: Column) -> Column:
    """Keep the last entry of every key (a map would reject duplicates)."""
    backwards = F.reverse(entries)
    keys = F.transform(backwards, lambda e: e.key)
    return F.filter(backwards, lambda e, i: F.array_position(keys, e.key) == i + 1)


def with_front_matter(
    df: DataFrame, content: str = "content", mode: str = QUARANTINE
) -> DataFrame:
    """Replace ``content`` by ``meta``, ``body`` and ``error``.

    The content is cut at its first two delimiter lines only; the body is never
    split into lines.
    """
    parts = F.split(universal_newlines(F.col(content)), _DELIMITER_LINE, 3)
    staged = df.withColumn("_parts", parts).drop(content)
    opened = (F.size("_parts") > 1) & (F.get("_parts", F.lit(0)) == "")
    block = F.get("_parts", F.lit(1))
    raw_lines = F.split(block, "\n")
    error = first_error(
        ("null_content", F.col("_parts").isNull()),
        ("missing_opening", ~opened),
        ("missing_closing", F.size("_parts") < 3),
        (
            "malformed_line",
            F.exists(raw_lines, lambda line: (strip(line) != "") & ~line.contains(":")),
        ),
        ("empty_front_matter", strip(block) == ""),
    )
    staged = staged.withColumn("error", error)
    meta = F.map_from_entries(_last_per_key(_entries(block)))
    body = F.regexp_replace(F.get("_parts", F.lit(2)), r"\A\n+|\n+\z", "")
    out = staged.withColumn("meta", guarded(meta, F.col("error"))).withColumn(
        "body", guarded(body, F.col("error"))
    )
    return enforce(out.drop("_parts"), mode)


def coerce(value: Column) -> Column:
    """Typed reading of one front-matter value: ``(raw, kind, bool_val, long_val)``.

    ``true``/``false`` in any case are booleans, integers may have a sign and
    single underscores; one that exceeds 64 bits stays a string.
    """
    lowered = F.lower(value)
    as_bool = F.when(lowered == "true", True).when(lowered == "false", False)
    as_long = F.when(
        value.rlike(_INTEGER), F.replace(value, F.lit("_"), F.lit("")).try_cast("bigint")
    )
    kind = (
        F.when(as_bool.isNotNull(), "bool")
        .when(as_long.isNotNull(), "int")
        .when(value.isNotNull(), "string")
    )
    return F.struct(
        value.alias("raw"),
        kind.alias("kind"),
        as_bool.alias("bool_val"),
        as_long.alias("long_val"),
    )


def with_known_keys(df: DataFrame, meta: str = "meta") -> DataFrame:
    """Typed columns for the declared keys; a key that is absent or of another type is NULL."""
    reads = {"string": lambda v: v, "bigint": lambda v: coerce(v).long_val, "boolean": lambda v: coerce(v).bool_val}
    return df.withColumns(
        {
            key: reads[kind](F.try_element_at(F.col(meta), F.lit(key)))
            for key, kind in KNOWN_KEYS.items()
        }
    )


def load_stimuli(
    spark: SparkSession, path: str | list[str], mode: str = QUARANTINE
) -> DataFrame:
    """All stimulus files below the given paths, parsed and typed, one row per file."""
    return with_known_keys(with_front_matter(read_texts(spark, path), "content", mode))
