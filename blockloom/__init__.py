"""Block-incremental SQL on Spark."""
