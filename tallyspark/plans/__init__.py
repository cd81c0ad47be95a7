"""Check suites and the views that bind the operators to the given tables."""
