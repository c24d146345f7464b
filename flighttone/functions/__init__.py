"""Per-recording attributes."""
