"""DataFrame operators: joins, map algebra, field statistics, correlations."""
