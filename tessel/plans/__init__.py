"""Semantic model and the planner that turns metric requests into DataFrames."""
