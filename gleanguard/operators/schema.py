"""The columns of documents and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: path and content (text) are enough; what is missing is filled with a regular text file's values.
DOCUMENT_DEFAULTS = {"is_binary": "boolean", "mode": "int", "is_symlink": "boolean", "symlink_target": "string"}

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}
_COLUMNS = (
    "type string, severity int, confidence double, file string, line int, column int, value string, reason string, rule_id string, "
    "tags strings, action string, context string, source_line string, detector_ord int, rule_ord int, pattern_ord int, match_ord int"
)
FINDING = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in _COLUMNS.split(", "))])
#: Findings in this order are in the order of files, detectors, rules, patterns and places.
ORDER = ("file", "detector_ord", "rule_ord", "pattern_ord", "match_ord")


def documents(df: DataFrame) -> DataFrame:
    """path, content and the columns of DOCUMENT_DEFAULTS."""
    given = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in DOCUMENT_DEFAULTS.items()]
    return df.select("path", "content", *given).withColumn("is_binary", F.coalesce("is_binary", F.lit(False)))


def finding(**columns: Column) -> list[Column]:
    """The columns of FINDING; those that are not given are null, empty optional texts too."""
    return [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING]


#: An array of findings, what a detector gives for one document.
FINDINGS = T.ArrayType(FINDING)


def exploded(df: DataFrame) -> DataFrame:
    """The findings in the column `found`, an array for each document, as rows."""
    return df.select(F.explode("found").alias("one")).select("one.*")
