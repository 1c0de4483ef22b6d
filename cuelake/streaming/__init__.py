"""Streaming forms of the engine's stateful operators."""
