"""Table movement, reconciliation and database telemetry on Spark DataFrames."""

__version__ = "0.1.0"
