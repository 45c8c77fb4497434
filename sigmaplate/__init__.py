"""Probabilistic models, estimators, learners and evaluation as Spark DataFrame queries."""
