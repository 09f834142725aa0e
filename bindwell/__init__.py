"""Bindwell: binding history analytics and training-data jobs for Spark DataFrames."""
