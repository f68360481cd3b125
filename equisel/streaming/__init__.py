"""Structured Streaming over growing trial / report logs."""
