"""Query plans over the test tables: Spark side and DuckDB oracle side."""
