"""Readers and writers for text, tables, mail, folders, rosters and registries."""
