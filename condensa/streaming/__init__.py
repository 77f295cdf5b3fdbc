"""Structured Streaming forms of the services' queues and limits."""
