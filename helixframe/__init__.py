"""Sequence-reduction and assembly-graph analytics on Spark DataFrames."""
