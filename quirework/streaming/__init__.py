"""Incremental compilation of arriving documents."""
