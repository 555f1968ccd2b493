"""Live stacking and monitoring on Structured Streaming."""
