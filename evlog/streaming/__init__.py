"""Read models kept up to date by Structured Streaming."""
