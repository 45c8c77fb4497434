"""Declared models and their lowering to message tables."""
