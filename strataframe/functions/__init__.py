"""Part of strataframe."""
