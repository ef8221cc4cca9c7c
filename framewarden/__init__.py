"""Analytics over object-detection event tables, as DataFrame operators on Spark."""
