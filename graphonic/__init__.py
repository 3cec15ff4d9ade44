"""Spelling-to-phoneme analytics on Spark DataFrames."""
