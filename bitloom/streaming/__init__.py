"""Structured Streaming forms of operators that have one."""
