"""The same plans on Structured Streaming."""
