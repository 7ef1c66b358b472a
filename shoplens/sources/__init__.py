"""Readers and writers of tables, feeds and documents."""
