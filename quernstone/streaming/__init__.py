"""Streaming extensions on the events table and the append log of predictions."""
