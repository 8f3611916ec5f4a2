"""docloom: document intelligence as Spark DataFrame jobs."""
