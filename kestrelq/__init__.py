"""kestrelq: an analytics engine expressed on Spark DataFrames, SQL and Structured Streaming."""
