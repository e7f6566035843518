"""Building the index's tables, and searching them."""
