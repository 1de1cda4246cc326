"""Table operators: pure ``DataFrame -> DataFrame`` functions."""
