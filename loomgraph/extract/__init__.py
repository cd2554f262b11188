"""Source text to definitions, call sites and comments."""
