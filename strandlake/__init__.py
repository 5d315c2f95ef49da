"""Strandlake: alignment statistics and selection as lazy Spark DataFrame plans."""
