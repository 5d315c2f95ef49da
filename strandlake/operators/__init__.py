"""Relational operators on alignments; each takes and returns lazy DataFrames."""
