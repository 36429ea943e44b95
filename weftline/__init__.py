"""Sequence segmentation and dependence analytics on Spark DataFrames."""
