"""Traceable text evidence on Spark: spans, windows, reductions, rankings and checks as DataFrame plans."""
