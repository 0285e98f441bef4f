"""Trajectory and preference analytics on Spark DataFrames."""
