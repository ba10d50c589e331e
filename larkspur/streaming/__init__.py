"""The event fold, in batch and in Structured Streaming."""
