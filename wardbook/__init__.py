"""Cleaning, validation, repair and risk analytics for coded record tables on Spark.

Every operator takes DataFrames and column names, codes or thresholds, and
returns a lazy DataFrame built from native Column expressions.
"""

from wardbook.session import prepare, scratch_path

__all__ = ["prepare", "scratch_path"]
