"""Durable sources and sinks: operation logs, snapshots, and the store over both."""
