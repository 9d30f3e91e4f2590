"""CSV / Parquet / JSON readers and sinks with explicit schemas.

CSV cells are quoted, with '"' as the escape character; cells with line breaks are
read on request.  Scratch output goes under the shared checkpoint folder
(``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rejoinder.session import checkpoint_dir

REPORT_FORMATS = ("csv", "json", "parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return os.path.join(checkpoint_dir(spark), "rejoinder-io", f"{name}-{uuid.uuid4().hex}")


#: How a null cell is written; an empty string is written as a quoted empty cell.
NULL_CELL = "\\N"


def _csv(options, sep: str):
    return (options.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("nullValue", NULL_CELL).option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, *, sep: str = ",",
             multi_line: bool = False) -> DataFrame:
    """``multi_line`` reads cells that hold line breaks; each file is then one task."""
    return _csv(spark.read.schema(schema), sep).option("multiLine", multi_line).csv(path)


def write_csv(df: DataFrame, path: str, *, sep: str = ",") -> None:
    """Every cell is quoted, so outer spaces and empty strings come back; nulls are ``NULL_CELL``."""
    _csv(df.write.mode("overwrite"), sep).option("quoteAll", True).csv(path)


def write_by_theme(df: DataFrame, path: str, *, theme_col: str = "theme") -> None:
    """One pass writes every theme; readers select a theme by partition pruning."""
    df.write.mode("overwrite").partitionBy(theme_col).parquet(path)


def read_theme(spark: SparkSession, path: str, theme, *, theme_col: str = "theme") -> DataFrame:
    return spark.read.parquet(path).where(F.col(theme_col) == F.lit(theme))


def write_report(df: DataFrame, path: str, fmt: str) -> None:
    """Result tables: csv (with header), json or parquet; anything else raises ValueError.

    The result keeps its partitions: a file per task, none that all rows pass through.
    """
    if fmt not in REPORT_FORMATS:
        raise ValueError(f"Invalid output format {fmt!r}. Choose one of {REPORT_FORMATS}.")
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def parse_nested_list(c, element: str = "string"):
    """Stringified nested list (Python repr) -> ARRAY<ARRAY<element>>.

    ``None``, ``True`` and ``False`` outside quotes become null, true and false.  A cell that is
    no such list raises; a null cell stays null.
    """
    c = F.col(c) if isinstance(c, str) else c
    # pieces: quoted strings, bare words, and what stands between them
    pieces = F.regexp_extract_all(c, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\w+|[^\w'"]+|['"])"""), 1)
    j = F.array_join(F.transform(pieces, lambda t: F.when(t == "None", "null").when(t == "True", "true")
                                 .when(t == "False", "false").otherwise(t)), "")
    parsed = F.from_json(j, f"array<array<{element}>>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a nested list: "), c))) \
        .otherwise(parsed)


def model_from_path(path_col=None):
    """Model label from a file's base name: 'gpt' -> gpt-4o, 'llama' -> llama, otherwise mistral.

    Without ``path_col`` the name is that of the file read, or of its folder if Spark named the file (``part-...``).
    """
    p = F.col("_metadata.file_path") if path_col is None else path_col
    parts = F.split(F.regexp_replace(p, "/+$", ""), "/")
    last = F.element_at(parts, -1)
    name = F.when(last.startswith("part-"), F.coalesce(F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)
    return (F.when(name.contains("gpt"), F.lit("gpt-4o")).when(name.contains("llama"), F.lit("llama"))
            .otherwise(F.lit("mistral")))
