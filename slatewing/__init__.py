"""A Spark-native engine for declared, pipe-delimited and Parquet tables."""
