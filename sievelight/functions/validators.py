"""Acceptance tests for candidate values, as SQL expressions over an expression ``v``."""

from __future__ import annotations

from . import fixed
from .sql import any_of, contains_any, find_all, fold, in_list, let, lit

# a digit string with at least four different digits
_FOUR_DISTINCT = r"^(\d)\d*?(?!\1)(\d)\d*?(?!\1|\2)(\d)\d*?(?!\1|\2|\3)\d"


def strip(v: str) -> str:
    """Trim Unicode white space on both sides."""
    return f"btrim({v}, {lit(fixed.WHITE_SPACE)})"


def digits_only(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def distinct_digit_count(v: str) -> str:
    return f"size(array_distinct(regexp_extract_all({v}, '[0-9]', 0)))"


def has_long_run(v: str, n: int) -> str:
    """Same character at least ``n`` times in a row."""
    return f"{v} rlike {lit(rf'(?s)(.)\1{{{n - 1}}}')}"


def is_sequential_number(v: str) -> str:
    """At least six digits, each one up (or each one down) from the one before."""
    return f"(length({v}) >= 6 and (contains('0123456789', {v}) or contains('9876543210', {v})))"


def plausible_digits(v: str) -> str:
    return (
        f"({v} rlike {lit(_FOUR_DISTINCT)} and not ({has_long_run(v, 6)}) "
        f"and not {is_sequential_number(v)})"
    )


def phone_ok(v: str, phone_locale: str = "other") -> str:
    """Phone acceptance; ``phone_locale`` is one of fr, es, de, other."""
    local = {"fr": fixed.PHONE_FR, "es": fixed.PHONE_ES}.get(phone_locale, fixed.PHONE_OTHER)

    def accept(s: str) -> str:
        digits = let(
            digits_only(s),
            lambda d: f"(({s} rlike {lit(fixed.PHONE_E164)} or (length({d}) between 8 and 12 "
            f"and {s} rlike {lit(local)})) and {plausible_digits(d)})",
        )
        return f"(not contains({s}, '/') and {digits})"

    return let(strip(v), accept)


def card_network_ok(v: str) -> str:
    """Known issuer prefix and length, on top of plausible digits."""
    n = f"length({v})"
    head = lambda k: f"try_cast(left({v}, {k}) as int)"
    return (
        f"({plausible_digits(v)} and ("
        f"(startswith({v}, '4') and {in_list(n, [13, 16, 19])})"
        f" or ({n} = 16 and ({head(2)} between 51 and 55 or {head(4)} between 2221 and 2720"
        f" or {head(4)} between 3528 and 3589))"
        f" or ({n} = 15 and {in_list(head(2), [34, 37])})"
        f" or ({in_list(n, [16, 19])} and ({head(4)} = 6011 or {head(2)} = 65"
        f" or {head(3)} between 644 and 649))"
        f" or ({n} = 14 and ({head(3)} between 300 and 305 or {in_list(head(2), [36, 38, 39])}))))"
    )


def card_ok(v: str) -> str:
    return f"(length({v}) between 13 and 19 and luhn_check({v}) and {card_network_ok(v)})"


def iban_ok(v: str) -> str:
    """15-34 letters/digits whose rearranged number leaves 1 modulo 97."""

    def mod97(s: str) -> str:
        chars = find_all(f"concat(substr({s}, 5), left({s}, 4))", ".")
        return fold(
            chars,
            "0",
            lambda m, c: f"case when {c} between '0' and '9' then ({m} * 10 + ascii({c}) - 48) % 97 "
            f"else ({m} * 100 + ascii({c}) - 55) % 97 end",
        )

    return let(
        f"upper(regexp_replace({v}, '[^A-Za-z0-9]', ''))",
        lambda s: f"(length({s}) between 15 and 34 and {mod97(s)} = 1)",
    )


def looks_like_secret_value(v: str) -> str:
    return let(
        strip(v),
        lambda s: f"(octet_length({s}) >= 10 and not ({s} rlike '^[0-9]+$') "
        f"and not ({has_long_run(s, 8)}) and (octet_length({s}) >= 24 or "
        f"({s} rlike '[A-Z]' and {s} rlike '[a-z]' and {s} rlike '[0-9_-]')))",
    )


def looks_like_secret_key(key: str) -> str:
    plain = f"translate(lower({key}), '_-', '')"
    return f"({in_list(plain, fixed.SECRET_KEY_NAMES)})"


def calendar_text(text: str) -> str:
    return contains_any(text, ["BEGIN:VCALENDAR", "BEGIN:VEVENT"])


def calendar_noise(v: str, text: str) -> str:
    return f"(octet_length({v}) < 24 and {calendar_text(text)})"


def address_value_ok(v: str) -> str:
    words = "|".join(fixed.STREET_WORDS)
    return let(
        f"lower({strip(v)})",
        lambda s: f"(octet_length({s}) >= 8 and concat(' ', {s}, ' ') rlike {lit(f' (?:{words}) ')} "
        f"and {s} rlike '[0-9]')",
    )


def is_example_email(v: str) -> str:
    return let(
        f"lower({v})",
        lambda s: any_of(f"endswith({s}, {lit(e)})" for e in fixed.EXAMPLE_MAIL_ENDINGS),
    )


def is_local_ip(v: str) -> str:
    p = r"^(?:127|10|172\.(?:1[6-9]|2\d|3[01])|192\.168|169\.254)\."
    return f"({v} rlike {lit(p)})"


def is_section_number_like(v: str) -> str:
    """All four octets are 31 or less."""
    low = r"(?:[0-2]?\d|3[01])"
    return f"({v} rlike {lit(rf'^{low}(?:\.{low}){{3}}$')})"


def looks_like_svg(text: str) -> str:
    return contains_any(f"lower({text})", fixed.SVG_MARKS)


def looks_like_hash(v: str) -> str:
    return let(
        strip(v),
        lambda s: f"({s} rlike '^(?:[0-9A-Fa-f]{{32}}|[0-9A-Fa-f]{{40}}|[0-9A-Fa-f]{{64}})$' "
        f"or ({s} rlike '^[A-Za-z0-9_+/=-]{{22,}}$' "
        f"and length({digits_only(s)}) * 3 < octet_length({s})))",
    )
