"""Analytics over robot-learning episodes (ordered frames) as Spark DataFrame jobs."""
