"""marketloom: a Spark-native engine for quantitative research tables."""
