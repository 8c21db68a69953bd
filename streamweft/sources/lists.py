"""Text lists that name the files of a field, and seed files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class FieldList:
    """``dims`` is None where each file has its own header."""

    files: list[str]
    dims: tuple[int, int, int] | None = None
    scale: float = 1.0
    variables: list[str] = field(default_factory=list)

    @property
    def mode(self) -> str:
        return "RAW_HEADER" if self.dims is None else "RAW"


def _words(path: str, comments: bool = True) -> list[list[str]]:
    with open(path, encoding="utf-8") as f:
        lines = [(line.split("#", 1)[0] if comments else line).split() for line in f]
    return [w for w in lines if w]


def _near(path: str, name: str) -> str:
    return name if os.path.isabs(name) else os.path.join(os.path.dirname(os.path.abspath(path)), name)


def read_list(path: str) -> FieldList:
    """``nt [nx ny nz]`` then one file name a step; four numbers mean files without headers.
    Names are relative to the list's folder."""
    words = _words(path)
    head = words[0]
    names = head[1:] if len(head) > 1 and len(head) != 4 else []
    names += [w for line in words[1:] for w in line]
    n = int(head[0])
    return FieldList([_near(path, x) for x in names[:n]], tuple(map(int, head[1:4])) if len(head) == 4 else None)


def read_parallel_list(path: str) -> FieldList:
    """``nx ny nz nt``, then a scale, then the file names."""
    words = _words(path)
    nx, ny, nz, nt = map(int, words[0][:4])
    names = [w for line in words[2:] for w in line]
    return FieldList([_near(path, x) for x in names[:nt]], (nx, ny, nz), float(words[1][0]))


def read_seed_file(spark: SparkSession, path: str) -> DataFrame:
    """``N`` then N times ``x y z``: (seed_id, x, y, z)."""
    from pyspark.sql import functions as F

    words = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("w"))
    rows = words.select("w", F.explode(F.sequence(F.lit(0), F.element_at("w", 1).cast("int") - 1)).alias("n")).where(F.element_at("w", 1).cast("int") > 0)
    return rows.select(F.col("n").cast("long").alias("seed_id"), *(F.get("w", 1 + F.col("n") * 3 + k).cast("double").alias(p) for k, p in enumerate("xyz")))
