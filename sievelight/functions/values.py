"""Normalised, salted value hashes for the ignore list, as SQL expressions."""

from __future__ import annotations

from .sql import let, lit
from .validators import strip


def normalize_value(category: str, value: str) -> str:
    return let(
        strip(value),
        lambda v: f"case {category} when 'email' then lower({v}) "
        f"when 'iban' then upper(regexp_replace({v}, '[^A-Za-z0-9]', '')) "
        f"when 'phone' then regexp_replace({v}, '[^0-9]', '') else {v} end",
    )


def value_hash(salt: str, category: str, value: str) -> str:
    """SHA-256 of salt, newline and normalised value."""
    return f"sha2(concat({lit(salt)}, '\\n', {normalize_value(category, value)}), 256)"
