"""Where tables come from and go to: CSV extracts, layer tables, the test tables."""
