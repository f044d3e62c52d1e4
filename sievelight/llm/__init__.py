"""Operators for preparing training data: mixing, search, chat, tokens, duplicates, pages, quality."""
