"""Masking of values, one rule per category, as SQL expressions."""

from __future__ import annotations

from .sql import lit
from .validators import digits_only


def redact_prefix(v: str, keep: int) -> str:
    """Keep the first ``keep`` characters, mask the rest."""
    return f"concat(left({v}, {keep}), repeat('*', greatest(length({v}) - {keep}, 0)))"


def redact_last(v: str, keep: int = 4) -> str:
    """Keep the last ``keep`` characters; shorter values are masked whole."""
    return (
        f"case when length({v}) <= {keep} then repeat('*', greatest(length({v}), 1)) "
        f"else concat(repeat('*', length({v}) - {keep}), right({v}, {keep})) end"
    )


def redact_phone(v: str) -> str:
    """Keep the first two and last two digits and all punctuation."""
    shape = lit(r"(?s)^([^0-9]*[0-9][^0-9]*[0-9])(.*)([0-9][^0-9]*[0-9][^0-9]*)$")
    part = lambda g: f"regexp_extract({v}, {shape}, {g})"
    return (
        f"case when length({digits_only(v)}) <= 4 then regexp_replace({v}, '[0-9]', '*') "
        f"else concat({part(1)}, regexp_replace({part(2)}, '[0-9]', '*'), {part(3)}) end"
    )


def redact_email(v: str) -> str:
    """Three characters of the local part, then the domain."""
    return (
        f"case when size(split({v}, '@')) = 2 then "
        f"concat(left(split_part({v}, '@', 1), 3), '***@', split_part({v}, '@', 2)) "
        f"else {redact_prefix(v, 6)} end"
    )


def redact_iban(v: str) -> str:
    clean = f"upper(regexp_replace({v}, '[^A-Za-z0-9]', ''))"
    return (
        f"case when length({clean}) < 8 then {redact_prefix(clean, 4)} else "
        f"concat(left({clean}, 4), repeat('*', length({clean}) - 7), right({clean}, 3)) end"
    )


def redact(category: str, v: str) -> str:
    """Redacted form of ``v``; rule names and unknown categories keep the last four."""
    return (
        f"case {category} when 'email' then {redact_email(v)} "
        f"when 'phone' then {redact_phone(v)} when 'iban' then {redact_iban(v)} "
        f"when 'ip_address' then {redact_prefix(v, 7)} when 'address' then {redact_prefix(v, 10)} "
        f"when 'postal_code' then {redact_prefix(v, 2)} "
        f"when 'date_of_birth' then {redact_prefix(v, 4)} "
        f"when 'file_name_signal' then {redact_prefix(v, 12)} "
        f"when 'weak_archive_encryption' then {v} else {redact_last(v)} end"
    )
