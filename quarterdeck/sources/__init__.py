"""Reading landed files and nested payloads, writing tables."""
