"""Settings of the engine with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .errors import ArgumentValueError


@dataclass(frozen=True)
class Config:
    """Read from the session's ``spark.spantrack.<name>`` where set."""

    #: Items of merged texts that are kept.
    max_concat: int = 20
    #: Significant digits of written numbers.
    output_precision: int = 4
    #: Grid of the position index, in positions.
    comp_bin_size: int = 100_000
    #: Suffix of files with headers, and the word before ``version`` and ``subtype`` in them.
    header_suffix: str = "headed"
    header_keyword: str = "format"

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        given = {}
        for f in fields(cls):
            text = spark.conf.get(f"spark.spantrack.{f.name}", None)
            if text is None:
                continue
            if f.type == "int" and not text.strip().isdigit():
                raise ArgumentValueError(f"spark.spantrack.{f.name} must be a whole number")
            given[f.name] = int(text) if f.type == "int" else text
        return cls(**given)
