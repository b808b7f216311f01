"""PySpark engine for sequence similarity, read assembly and corpus preparation."""
