"""PySpark-native engine for long, wide measurement logs."""
