"""Operators over tables: inference messages, estimators, metrics, relational preparation."""
