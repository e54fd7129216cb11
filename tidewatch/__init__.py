"""tidewatch: payment-risk analytics on Spark DataFrames and Structured Streaming."""
