"""The chain on streams."""
