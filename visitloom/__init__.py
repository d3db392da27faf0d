"""visitloom: a PySpark-native engine for longitudinal record analytics."""
