"""A PySpark-native engine for source-qualified ledger observations."""
