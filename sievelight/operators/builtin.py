"""Built-in detectors over a text column.

Every detector is a SQL expression ``text -> array<string>`` of accepted values in the order
they are found, so a whole scan stays a narrow projection: no shuffle, no Python worker.
``low`` is an expression of the text in lower case; keyword patterns run only on texts that
mention one of their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import validators as V
from ..functions.patterns import quick_start, safe_pattern
from ..functions.sql import (
    NO_STRINGS,
    array,
    contains_any,
    each,
    each_at,
    find_all,
    first_n,
    fold,
    guarded,
    in_list,
    keep,
    let,
    lit,
    some,
    struct,
    zipped,
)
from ..functions.text import file_extension, normalize_file_stem
from ..plans.session import pin

HITS_TYPE = "array<struct<category:string,vals:array<string>>>"
PAIRS_TYPE = "array<struct<key:string,value:string>>"
EMPTY_HITS = f"cast(array() as {HITS_TYPE})"

# words without which a keyword pattern cannot match (in lower case)
_SECRET_WORDS = ["key", "token", "secret", "pass", "pwd"]
_ADDRESS_WORDS = ["addr", "adresse", "direccion", "anschrift", "street", "rue", "calle", "stra", "عنوان"]
_POSTAL_WORDS = ["postal", "postcode", "zip", "plz", "الرمز"]
_BIRTH_WORDS = ["naissance", "dob", "birth", "geburtsdatum", "nacimiento", "الميلاد"]
# categories that use the lower-case text, the identifier pairs and the long numbers
_LOW_USERS = ["address", "postal_code", "date_of_birth", "secret"]
_PAIRS_USERS = ["cookie", "user_id"]
_NUMBERS_USERS = ["phone", "credit_card"]

_IPV4 = r"(?=\d{1,3}\.\d)" + fixed.IPV4
_DEVICE_HINT = quick_start(fixed.DEVICE_HINT)


def _has_separator(text: str) -> str:
    return contains_any(text, [":", "=", "->"])


def key_values(text: str, pattern: str, unicode: bool = False) -> str:
    """``array<struct<key,value>>`` of key/separator/value hits, found in one pass.

    Keys never hold a separator, so each hit splits at its first one.
    """
    split_at = lit(("(?U)" if unicode else "") + r"(?s)^(.+?)\s*(?:[:=]|->)\s*(.+)$")
    return each(
        find_all(text, pattern, 0, unicode),
        lambda m: struct(
            key=f"regexp_extract({m}, {split_at}, 1)", value=f"regexp_extract({m}, {split_at}, 2)"
        ),
    )


def emails(text: str, unicode: bool = False) -> str:
    """An address holds no blank, so only the words with an @ are searched."""
    words = keep(f"split({text}, ' ', -1)", lambda w: f"contains({w}, '@')")
    found = f"flatten({each(words, lambda w: find_all(w, fixed.EMAIL, 0, unicode))})"
    return guarded(
        f"contains({text}, '@')",
        keep(found, lambda v: f"not {V.is_example_email(v)}"),
    )


_NETWORK_WORD = r"(?<![a-z0-9])(?:" + "|".join(fixed.NETWORK_WORDS) + r")(?![a-z0-9])"


def _network_context(text: str, ips: str, unicode: bool) -> str:
    """For each address: is a network word within 64 bytes before or after it?

    The text between the addresses is cut down to its two edges, then each window is put
    together from the ten neighbours on either side, which always hold 64 bytes or reach the
    end of the text. The work is linear in the number of addresses.
    """
    p = ("(?U)" if unicode else "") + _IPV4
    edges = each(
        f"split({text}, {lit(p)}, -1)",
        lambda g: f"case when length({g}) > 128 then concat(left({g}, 64), right({g}, 64)) else {g} end",
    )

    def near(pieces: str, i: str) -> str:
        # address i is element 2i+2 (1-based), with its gaps at 2i+1 and 2i+3
        first = f"greatest({i} * 2 - 19, 1)"
        before = f"array_join(slice({pieces}, {first}, {i} * 2 + 2 - {first}), '')"
        after = f"array_join(slice({pieces}, {i} * 2 + 3, 21), '')"
        window = (
            f"concat(substring(cast({before} as binary), -64, 64), cast(' ' as binary), "
            f"substring(cast({after} as binary), 1, 64))"
        )
        return f"lower(make_valid_utf8(cast({window} as string))) rlike {lit(_NETWORK_WORD)}"

    return let(
        f"flatten({zipped(edges, ips, lambda g, m: f'''array({g}, coalesce({m}, ''))''')})",
        lambda pieces: each_at(ips, lambda _, i: near(pieces, i)),
    )


def public_ips(text: str, unicode: bool = False) -> str:
    """Public IPv4 addresses; look-alikes (section numbers, SVG paths) need a network word."""

    def accept(found: str) -> str:
        svg = V.looks_like_svg(text)
        unclear = some(
            found, lambda v: f"not {V.is_local_ip(v)} and {V.is_section_number_like(v)}"
        )
        judged = zipped(
            found, _network_context(text, found, unicode), lambda ip, near: struct(ip=ip, near=near)
        )
        in_context = each(
            keep(
                judged,
                lambda x: f"not {V.is_local_ip(f'{x}.ip')} and ({x}.near or "
                f"(not {V.is_section_number_like(f'{x}.ip')} and not {svg}))",
            ),
            lambda x: f"{x}.ip",
        )
        plain = keep(found, lambda v: f"not {V.is_local_ip(v)}")
        return (
            f"case when size({found}) = 0 then {NO_STRINGS} "
            f"when {unclear} or {svg} then {in_context} else {plain} end"
        )

    return let(find_all(text, _IPV4, 0, unicode), accept)


def ibans(text: str, unicode: bool = False) -> str:
    return keep(find_all(text, fixed.IBAN, 0, unicode), V.iban_ok)


def long_numbers(text: str, unicode: bool = False) -> str:
    """Runs of digits and separators: the candidates for phone numbers. Every card number lies
    in one, so a text without them holds no cards either."""
    return find_all(text, fixed.PHONE, 0, unicode)


def phones(numbers: str, phone_locale: str = "other") -> str:
    return keep(numbers, lambda v: V.phone_ok(v, phone_locale))


def cards(text: str, numbers: str, unicode: bool = False) -> str:
    """Payment cards, as digits only."""
    found = each(find_all(text, fixed.CARD, 0, unicode), V.digits_only)
    return guarded(f"size({numbers}) > 0", keep(found, V.card_ok))


def id_pairs(text: str, unicode: bool = False) -> str:
    """Identifier and cookie key-values as ``array<struct<key,value>>``, keys lower-case."""
    pairs = each(
        key_values(text, fixed.ID_KV, unicode),
        lambda kv: struct(key=f"lower({kv}.key)", value=f"{kv}.value"),
    )
    return guarded(_has_separator(text), pairs, f"cast(array() as {PAIRS_TYPE})")


def _is_cookie(kv: str) -> str:
    return f"{kv}.key rlike {lit(fixed.COOKIE_KEY)}"


def cookies(pairs: str) -> str:
    return each(keep(pairs, _is_cookie), lambda kv: f"{kv}.value")


def device_guids(text: str, unicode: bool = False) -> str:
    """GUIDs, only in texts that mention a device identifier."""
    hint = ("(?U)" if unicode else "") + _DEVICE_HINT
    found = let(
        find_all(text, fixed.GUID, 0, unicode),
        lambda g: guarded(f"size({g}) > 0 and {text} rlike {lit(hint)}", g),
    )
    return guarded(f"contains({text}, '-')", found)


def user_ids(pairs: str, text: str, unicode: bool = False) -> str:
    keyed = each(keep(pairs, lambda kv: f"not ({_is_cookie(kv)})"), lambda kv: f"{kv}.value")
    return f"concat({keyed}, {device_guids(text, unicode)})"


def _mentions(low: str, words: Sequence[str], unicode: bool) -> str:
    """Cheap necessary test for a keyword pattern."""
    return contains_any(low, words)


def lowered(text: str) -> str:
    """The text in lower case, with the letters that Unicode case folding takes for ASCII ones."""
    return f"lower(replace(replace(replace({text}, 'ſ', 's'), 'ı', 'i'), 'İ', 'i'))"


def secret_values(text: str, low: str, unicode: bool = False) -> str:
    """Values of secret-looking keys."""

    def accept(kv: str) -> str:
        return let(
            f"lower({kv}.key)",
            lambda k: f"(contains({k}, 'password') or {k} = 'pwd' or "
            f"({V.looks_like_secret_key(k)} and {V.looks_like_secret_value(f'{kv}.value')}))",
        )

    pairs = keep(key_values(text, fixed.SECRET_KV, unicode), accept)
    return guarded(
        f"{_has_separator(text)} and {_mentions(low, _SECRET_WORDS, unicode)}",
        each(pairs, lambda kv: f"{kv}.value"),
    )


def bearer_tokens(text: str, low: str, unicode: bool = False) -> str:
    return guarded(
        _mentions(low, ["bearer"], unicode),
        keep(find_all(text, fixed.BEARER, 1, unicode), V.looks_like_secret_value),
    )


def private_keys(text: str) -> str:
    return guarded(
        f"contains({text}, '-----') and {text} rlike {lit(fixed.PRIVATE_KEY)}",
        array([fixed.PRIVATE_KEY_VALUE]),
    )


def jwts(text: str, unicode: bool = False) -> str:
    return guarded(
        f"contains({text}, 'eyJ')",
        keep(
            find_all(text, fixed.JWT, 0, unicode),
            lambda v: f"{V.looks_like_secret_value(v)} and not {V.calendar_noise(v, text)}",
        ),
    )


def extra_secrets(text: str, patterns: Sequence[str], unicode: bool = False) -> str:
    """Hits of caller-supplied secret patterns (none are shipped)."""
    found = ", ".join(find_all(text, safe_pattern(p), 0, unicode) for p in patterns) or NO_STRINGS
    return keep(f"concat({found})", lambda v: f"not {V.calendar_noise(v, text)}")


def addresses(text: str, low: str, unicode: bool = False) -> str:
    return guarded(
        f"{contains_any(text, [':', '='])} and {_mentions(low, _ADDRESS_WORDS, unicode)}",
        each(keep(find_all(text, fixed.ADDRESS_KV, 1, unicode), V.address_value_ok), V.strip),
    )


def postal_codes(text: str, low: str, unicode: bool = False) -> str:
    return guarded(
        f"{contains_any(text, [':', '='])} and {_mentions(low, _POSTAL_WORDS, unicode)}",
        each(find_all(text, fixed.POSTAL_KV, 1, unicode), V.strip),
    )


def birth_dates(text: str, low: str, unicode: bool = False) -> str:
    return guarded(
        _mentions(low, _BIRTH_WORDS, unicode),
        each(find_all(text, fixed.BIRTH_DATE, 1, unicode), V.strip),
    )


def file_keywords(path: str) -> str:
    """``array<struct<keyword, score>>`` of the keywords that a file name holds as words."""
    rows = ", ".join(
        struct(
            keyword=lit(k),
            phrase=lit(" " + k.replace("_", " ").replace("-", " ") + " "),
            score=f"{s}L",
        )
        for k, s in fixed.FILE_NAME_KEYWORDS
    )
    return let(
        f"concat(' ', {normalize_file_stem(path)}, ' ')",
        lambda name: keep(f"array({rows})", lambda r: f"contains({name}, {r}.phrase)"),
    )


def with_file_signals(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``file_signals`` (keywords found, plus ``pst``) and ``file_bonus`` (their score)."""
    pst = f"{file_extension(path_col)} = 'pst'"
    names = f"concat({each('_kw', lambda r: f'{r}.keyword')}, {guarded(pst, array(['pst']))})"
    bonus = f"{fold('_kw', '0L', lambda a, r: f'{a} + {r}.score')} + case when {pst} then {fixed.PST_BONUS} else 0 end"
    return (
        df.selectExpr("*", f"{file_keywords(path_col)} as _kw")
        .selectExpr(
            *df.columns,
            f"coalesce({names}, {NO_STRINGS}) as file_signals",
            f"coalesce({bonus}, 0L) as file_bonus",
        )
    )


def text_values(
    text: str,
    pairs: str,
    numbers: str,
    low: str,
    digit: str = "true",
    *,
    secrets: str = "true",
    phone_locale: str = "other",
    extra_secret_patterns: Sequence[str] = (),
    unicode: bool = False,
) -> dict[str, str]:
    """Category -> expression of its accepted values.

    ``pairs`` comes from :func:`id_pairs`, ``numbers`` from :func:`long_numbers`; ``digit`` tells
    whether the text holds a digit, without which the number patterns cannot match.
    """
    gated = f"concat({jwts(text, unicode)}, {extra_secrets(text, extra_secret_patterns, unicode)})"
    secret = (
        f"concat({secret_values(text, low, unicode)}, {bearer_tokens(text, low, unicode)}, "
        f"{private_keys(text)}, {guarded(secrets, gated)})"
    )
    return {
        "email": emails(text, unicode),
        "phone": phones(numbers, phone_locale),
        "iban": guarded(digit, ibans(text, unicode)),
        "credit_card": cards(text, numbers, unicode),
        "ip_address": guarded(digit, public_ips(text, unicode)),
        "address": addresses(text, low, unicode),
        "postal_code": postal_codes(text, low, unicode),
        "date_of_birth": guarded(digit, birth_dates(text, low, unicode)),
        "cookie": cookies(pairs),
        "user_id": user_ids(pairs, text, unicode),
        "secret": secret,
    }


def as_hits(values: dict[str, str]) -> str:
    """Non-empty categories as ``array<struct<category, vals>>`` in category order."""
    entries = ", ".join(
        struct(category=lit(c), vals=values[c]) for c in fixed.CATEGORIES if c in values
    )
    return keep(f"array({entries})", lambda h: f"size({h}.vals) > 0")


def with_builtin_hits(
    df: DataFrame,
    text_col: str = "text",
    out: str = "hits",
    *,
    secrets: bool | str = True,
    phone_locale: str = "other",
    categories: Sequence[str] | None = None,
    extra_secret_patterns: Sequence[str] = (),
    cap: int | None = None,
    unicode: bool = True,
    target: str | None = None,
) -> DataFrame:
    """Add one column with all built-in matches of each row's whole text.

    ``secrets`` is a flag or the name of a boolean column. ``categories`` restricts the
    detectors that run. All values are reported, unless ``cap`` bounds them per category and row.
    ``unicode=False`` restricts digits, spaces, word borders and case folding to ASCII. ``target`` is a column with the one
    category that is wanted of a row; the detectors of others do not run on it.
    """
    of = lambda names, e, empty=NO_STRINGS: e if target is None else guarded(in_list(target, names), e, empty)
    values = text_values(
        text_col,
        "_pairs",
        "_numbers",
        "_low",
        "_digit",
        secrets=secrets if isinstance(secrets, str) else str(secrets).lower(),
        phone_locale=phone_locale,
        extra_secret_patterns=extra_secret_patterns,
        unicode=unicode,
    )
    wanted = [c for c in values if categories is None or c in categories]
    hits = as_hits({c: of([c], first_n(values[c], cap)) for c in wanted})
    # what several detectors use is computed once, in columns of its own
    any_digit = lit("(?U)\\d" if unicode else "[0-9]")
    helpers = df.selectExpr(
        "*",
        f"{of(_LOW_USERS, lowered(text_col), 'cast(null as string)')} as _low",
        f"{text_col} rlike {any_digit} as _digit",
        f"{of(_PAIRS_USERS, id_pairs(text_col, unicode), f'cast(array() as {PAIRS_TYPE})')} as _pairs",
    ).selectExpr("*", f"{of(_NUMBERS_USERS, guarded('_digit', long_numbers(text_col, unicode)))} as _numbers")
    return helpers.selectExpr(*[f"`{c}`" for c in df.columns], f"{hits} as {out}")


def explode_hits(
    df: DataFrame, id_cols: list[str], hits: str = "hits", scope: str = "builtin"
) -> DataFrame:
    """Long form: one row per match with ``scope, category, pos, value``."""
    rows = each(
        hits,
        lambda h: each_at(
            f"{h}.vals",
            lambda v, i: struct(category=f"{h}.category", pos=f"cast({i} as bigint)", value=v),
        ),
    )
    # the outer form keeps the optimizer from repeating the regexes in an extra filter
    return (
        df.selectExpr(*id_cols, f"inline_outer(flatten({rows}))")
        .filter(F.col("value").isNotNull())
        .select(*id_cols, F.lit(scope).alias("scope"), "category", "pos", "value")
    )


def detect_builtin(df: DataFrame, text_col: str, id_col: str, **options) -> DataFrame:
    """Built-in matches in long form, one row per accepted value."""
    return explode_hits(with_builtin_hits(df.select(id_col, text_col), text_col, **options), [id_col])


def detect_filename(df: DataFrame, path_col: str, id_col: str) -> DataFrame:
    """File-name keywords in long form, with the file's total ``bonus`` on each row."""
    signals = pin(with_file_signals(df.select(id_col, path_col), path_col), "file_signals", "file_bonus")
    return (
        signals.select(id_col, F.posexplode_outer("file_signals").alias("pos", "value"),
                       F.col("file_bonus").alias("bonus"))
        .filter(F.col("value").isNotNull())
        .select(
            id_col,
            F.lit("file_name_signal").alias("category"),
            F.col("pos").cast("bigint").alias("pos"),
            "value",
            "bonus",
        )
    )
