"""Analytics over text records, written as Spark DataFrame jobs."""
