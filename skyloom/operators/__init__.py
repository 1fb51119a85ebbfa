"""Operators: DataFrame(s) in, DataFrame(s) out. None runs a job of its own."""
