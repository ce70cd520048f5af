"""A Spark-first analytics library: relational, window, event-time, text and
vector operators written with the DataFrame, SQL and Structured Streaming APIs."""
