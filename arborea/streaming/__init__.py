"""Streams of edits: sessions, undo steps, autosaves; each has a batch twin with the same result."""
