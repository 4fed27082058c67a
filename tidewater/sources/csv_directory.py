"""A file or a directory of header-less CSV as rows of one JSON column: an array of each record's fields as strings."""

from __future__ import annotations

import csv
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_directory(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = False) -> DataFrame:
    """Rows (data string). Nested directories are read too; each record keeps its own number of fields.

    Records end with the line, so that large files are split among tasks; with
    `multiline` a quoted field may hold line ends, and each file is one task's.
    Lines without quotes and control characters are split in the JVM.
    """

    def records(texts):
        for row in csv.reader(texts, delimiter=delimiter, doublequote=True):
            if row:
                yield json.dumps(row, ensure_ascii=False, separators=(",", ":"))

    def parse(frames):
        for pdf in frames:
            lines = (line for text in pdf["value"] for line in text.splitlines(keepends=True))
            yield pd.DataFrame({"data": list(records(lines))})

    lines = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=multiline)
    if multiline:
        return lines.mapInPandas(parse, "data string")

    @F.pandas_udf("string")
    def record(line: pd.Series) -> pd.Series:
        # A quote that a line leaves open ends with the line.
        return line.map(lambda x: None if x is None else next(records([x]), None))

    line = F.col("value")
    odd = line.rlike('["\\x00-\\x1f\\\\]')
    plain = F.to_json(F.split(line, re.escape(delimiter), -1))
    return lines.where(line != "").select(F.when(odd, record(F.when(odd, line))).otherwise(plain).alias("data")).where("data IS NOT NULL")


def field(data, index: int):
    """Field `index` of a record as text, without Python: what ->> "$[index]" means for these arrays."""
    return F.get(F.from_json(data, "array<string>"), F.lit(index))
