"""Analytics over conversational long-term memory, written for Spark's DataFrame engine."""
