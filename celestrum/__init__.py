"""Sky statistics and data-pipeline operators on PySpark."""
