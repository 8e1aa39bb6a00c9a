"""Cohort monitoring, population stability and feature selection on Spark DataFrames."""
