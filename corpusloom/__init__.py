"""PySpark-native engine for preparing and auditing text corpora."""
