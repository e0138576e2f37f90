"""Redline: batch comparison of document pairs on Spark DataFrames."""
