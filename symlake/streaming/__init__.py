"""Streaming forms of the overlay log."""
