"""SQL for DuckDB that states, independently of Spark, what each registered query returns."""

from oracle.sql import ORACLES

__all__ = ["ORACLES"]
