"""Structured Streaming forms of the session operators; an extension of the batch ones."""
