"""Spark DataFrame operators for grading and forecasting tables."""
