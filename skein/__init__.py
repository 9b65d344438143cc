"""Skein: document-corpus analytics on Spark DataFrames."""
