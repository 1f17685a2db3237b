"""Results that arrive over time (Structured Streaming)."""
