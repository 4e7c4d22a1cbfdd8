"""Slackline: work functions, state graphs and potentials as Spark DataFrames."""
