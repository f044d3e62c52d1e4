"""Column functions: validators, redaction, text helpers."""
