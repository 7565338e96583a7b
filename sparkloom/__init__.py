"""A PySpark-native engine for guarded queries and deterministic analysis of tables and time series."""
