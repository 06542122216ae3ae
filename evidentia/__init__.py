"""Evidentia: document-evidence analytics on PySpark DataFrames."""
