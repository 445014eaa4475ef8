"""Tessella: knowledge-capture analytics as PySpark DataFrame plans."""
