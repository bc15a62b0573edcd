"""Readers and writers of tables, text files and JSON records."""
