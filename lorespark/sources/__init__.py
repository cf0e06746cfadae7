"""Readers: every source kind becomes rows of (source_id, kb_id, part, text, metadata)."""
