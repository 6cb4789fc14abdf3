"""Sieveline: asset-curation analytics on PySpark DataFrames."""
