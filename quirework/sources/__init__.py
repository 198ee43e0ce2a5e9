"""Reading documents and keeping compiled tables."""
