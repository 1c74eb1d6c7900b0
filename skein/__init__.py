"""Skein: typed dataflow pipelines, correlated subtasks, loops and graph workloads on Spark DataFrames."""
