"""Analytics over large collections of per-model sample tables, on Spark."""
