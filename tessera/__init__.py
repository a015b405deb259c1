"""Analytics over code-base, activity and text tables, written as Spark DataFrame jobs."""
