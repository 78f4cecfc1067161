"""A PySpark-native decision-support engine for supply-chain data."""
