"""Analytics over conversational decision data, expressed as Spark DataFrame operators."""
