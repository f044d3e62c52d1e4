"""Readers: tables, files, archives, sheets, rule catalogs, labelled cases."""
