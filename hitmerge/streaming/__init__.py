"""Structured Streaming: results are merged while engines are still answering."""
