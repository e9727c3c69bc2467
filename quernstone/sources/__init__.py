"""Readers and writers of the record formats, all by Spark's own sources."""
