"""Cohorts, episodes and condition periods over person-level tables, on Spark DataFrames."""
