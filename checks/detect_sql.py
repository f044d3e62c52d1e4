"""The detectors as plain SQL, for checking the Spark expressions.

Patterns come from the fixed values; acceptance, order and redaction are written again here.
"""

from __future__ import annotations

from sievelight.functions import fixed as f


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


_ID_KV = r"(?i)\b(" + f.ID_KEYS + r")\b\s*(?:[:=]|->)\s*([A-Za-z0-9._~\-+/=]{6,256})"
_SECRET_KV = r"(?i)\b(" + f.SECRET_KEYS + r")\b\s*(?:[:=]|->)\s*([A-Za-z0-9._~\-+/=]{8,256})"
GENERIC_KV = r"([A-Za-z0-9_\-.]{2,80})\s*(?:[:=]|->)\s*([^\n\r]{1,300})"

RUN6 = "|".join(str(d) * 6 for d in range(10))


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def plausible(v: str) -> str:
    return (
        f"(len(list_distinct(regexp_extract_all({v}, '[0-9]'))) >= 4"
        f" and not regexp_matches({v}, '{RUN6}')"
        f" and not (length({v}) >= 6 and (contains('0123456789', {v}) or contains('9876543210', {v}))))"
    )


def luhn(v: str) -> str:
    return (
        f"(list_sum(list_transform(regexp_extract_all(reverse({v}), '[0-9]'), lambda ch, ix: "
        "case when ix % 2 = 1 then ch::int when ch::int * 2 > 9 then ch::int * 2 - 9 "
        "else ch::int * 2 end)) % 10 = 0)"
    )


def card_ok(v: str) -> str:
    p = lambda n: f"try_cast(left({v}, {n}) as int)"
    n = f"length({v})"
    return (
        f"({n} between 13 and 19 and {luhn(v)} and {plausible(v)} and ("
        f"({v} like '4%' and {n} in (13, 16, 19))"
        f" or ({n} = 16 and ({p(2)} between 51 and 55 or {p(4)} between 2221 and 2720))"
        f" or ({n} = 15 and left({v}, 2) in ('34', '37'))"
        f" or ({n} in (16, 19) and ({v} like '6011%' or {v} like '65%' or {p(3)} between 644 and 649))"
        f" or ({n} = 16 and {p(4)} between 3528 and 3589)"
        f" or ({n} = 14 and ({p(3)} between 300 and 305 or left({v}, 2) in ('36', '38', '39')))))"
    )


def iban_ok(v: str) -> str:
    clean = f"upper(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g'))"
    moved = f"concat(substr({clean}, 5), left({clean}, 4))"
    numbers = (
        f"list_transform(regexp_extract_all({moved}, '.'), lambda ch: "
        "case when ch between '0' and '9' then ascii(ch) - 48 else ascii(ch) - 55 end)"
    )
    rest = (
        f"list_reduce({numbers}, lambda acc, x: "
        "case when x < 10 then (acc * 10 + x) % 97 else (acc * 100 + x) % 97 end, 0)"
    )
    return f"(length({clean}) between 15 and 34 and {rest} = 1)"


def phone_ok(v: str, locale: str = "other") -> str:
    local = {"fr": f.PHONE_FR, "es": f.PHONE_ES}.get(locale, f.PHONE_OTHER)
    return (
        f"(not contains({v}, '/') and {plausible(digits(v))} and (regexp_matches({v}, {q(f.PHONE_E164)})"
        f" or (length({digits(v)}) between 8 and 12 and regexp_matches({v}, {q(local)}))))"
    )


def secret_value(v: str) -> str:
    # a run of eight equal characters, written out because RE2 has no back-references
    chars = [chr(i) for i in range(33, 127)]
    run8 = " or ".join(f"contains({v}, repeat({q(c)}, 8))" for c in chars)
    return (
        f"(strlen({v}) >= 10 and not regexp_matches({v}, '^[0-9]+$') and not ({run8})"
        f" and (strlen({v}) >= 24 or (regexp_matches({v}, '[A-Z]') and regexp_matches({v}, '[a-z]')"
        f" and regexp_matches({v}, '[0-9_-]'))))"
    )


def secret_key(k: str) -> str:
    return f"(replace(replace({k}, '_', ''), '-', '') in {in_list(f.SECRET_KEY_NAMES)})"


def looks_like_hash(v: str) -> str:
    return (
        f"(regexp_matches({v}, '^([0-9A-Fa-f]{{32}}|[0-9A-Fa-f]{{40}}|[0-9A-Fa-f]{{64}})$')"
        f" or (regexp_matches({v}, '^[A-Za-z0-9_+/=-]{{22,}}$') and length({digits(v)}) * 3 < strlen({v})))"
    )


def _listed(ord_: int, src: int, expr: str, docs: str, where: str = "true") -> str:
    """Rows of one detector: ``expr`` is a list of accepted values."""
    return (
        f"select doc_id, {ord_} as ord, {src} as src, u.ix as ix, u.val as val from (select doc_id, "
        f"{expr} as vals from {docs} where {where}) t, "
        "lateral (select unnest(vals) as val, unnest(range(len(vals))) as ix) u"
    )


def all_matches(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, {q(pattern)}, {group})"


def _pairs(pattern: str) -> str:
    return f"list_zip({all_matches(pattern, 1)}, {all_matches(pattern, 2)})"


def _keep(list_expr: str, test) -> str:
    return f"list_filter({list_expr}, lambda v: {test('v')})"


NETWORK = r"(^|[^a-z0-9])(" + "|".join(f.NETWORK_WORDS) + r")([^a-z0-9]|$)"


def _local_ip(v: str) -> str:
    return (
        f"regexp_matches({v}, "
        r"'^(127|10|172\.(1[6-9]|2[0-9]|3[01])|192\.168|169\.254)\.')"
    )


def ip_values(docs: str) -> str:
    """Public addresses by byte position: gaps and matches are unnested and lengths summed.

    ``flat`` has one character per byte of the text.
    """
    low = " and ".join(f"split_part(val, '.', {i})::int <= 31" for i in range(1, 5))
    svg = " or ".join(f"contains(lower(text), {q(m)})" for m in f.SVG_MARKS)
    flat = (
        "array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda ch: "
        "case when strlen(ch) = 1 then ch else repeat('~', strlen(ch)::int) end), '')"
    )
    return f"""
      select doc_id, 5 as ord, 0 as src, ix, val from (
        select *, sum(strlen(gap) + strlen(val)) over (partition by doc_id order by ix) as stop
        from (select doc_id, text, flat, unnest(vals) as val, unnest(gaps[:len(vals)]) as gap,
                     unnest(range(len(vals))) as ix
              from (select doc_id, text, vals, {flat} as flat,
                           string_split_regex(text, {q(f.IPV4)}) as gaps
                    from (select doc_id, text, {all_matches(f.IPV4)} as vals from {docs})
                    where len(vals) > 0))
      )
      where not {_local_ip('val')} and (
        (not ({low}) and not ({svg}))
        or regexp_matches(lower(concat(
             substr(flat, greatest(stop - strlen(val) - 64, 0)::int + 1,
                    (stop - strlen(val) - greatest(stop - strlen(val) - 64, 0))::int),
             ' ', substr(flat, stop::int + 1, 64))), {q(NETWORK)}))
    """


def detector_sql(docs: str, phone_locale: str = "other") -> dict[str, list[str]]:
    """Category -> selects of ``doc_id, ord, src, ix, val``, in call order."""
    o = {c: i + 1 for i, c in enumerate(f.CATEGORIES)}
    cookie = "regexp_matches(v[1], 'cookie|session|vec|^sid$')"
    ids = f"list_transform({_pairs(_ID_KV)}, lambda p: [lower(p[1]), p[2]])"
    calendar = "(contains(text, 'BEGIN:VCALENDAR') or contains(text, 'BEGIN:VEVENT'))"
    words = "|".join(f.STREET_WORDS)
    example = r"'@(example\.(com|org|net)|test\.com|localhost)$'"
    strip = lambda e: f"list_transform({e}, lambda v: trim(v, {q(' ')} || chr(9) || chr(10) || chr(13)))"
    secret_pairs = (
        f"list_filter(list_transform({_pairs(_SECRET_KV)}, lambda p: [lower(p[1]), p[2]]), lambda v: "
        f"contains(v[1], 'password') or v[1] = 'pwd' or ({secret_key('v[1]')} and {secret_value('v[2]')}))"
    )
    address = (
        f"list_filter({strip(all_matches(f.ADDRESS_KV, 1))}, lambda v: strlen(v) >= 8 and "
        f"regexp_matches(concat(' ', lower(v), ' '), ' ({words}) ') and regexp_matches(v, '[0-9]'))"
    )
    second = lambda e: f"list_transform({e}, lambda v: v[2])"
    return {
        "email": [_listed(o["email"], 0, f"list_filter({all_matches(f.EMAIL)}, lambda v: not regexp_matches(lower(v), {example}))", docs)],
        "phone": [_listed(o["phone"], 0, _keep(all_matches(f.PHONE), lambda v: phone_ok(v, phone_locale)), docs)],
        "iban": [_listed(o["iban"], 0, _keep(all_matches(f.IBAN), iban_ok), docs)],
        "credit_card": [_listed(o["credit_card"], 0, _keep(f"list_transform({all_matches(f.CARD)}, lambda c: {digits('c')})", card_ok), docs)],
        "ip_address": [ip_values(docs)],
        "address": [_listed(o["address"], 0, address, docs)],
        "postal_code": [_listed(o["postal_code"], 0, strip(all_matches(f.POSTAL_KV, 1)), docs)],
        "date_of_birth": [_listed(o["date_of_birth"], 0, all_matches(f.BIRTH_DATE, 1), docs)],
        "cookie": [_listed(o["cookie"], 0, second(f"list_filter({ids}, lambda v: {cookie})"), docs)],
        "user_id": [
            _listed(o["user_id"], 0, second(f"list_filter({ids}, lambda v: not {cookie})"), docs),
            _listed(o["user_id"], 1, all_matches(f.GUID), docs, f"regexp_matches(text, {q(f.DEVICE_HINT)})"),
        ],
        "secret": [
            _listed(o["secret"], 0, second(secret_pairs), docs),
            _listed(o["secret"], 1, _keep(all_matches(f.BEARER, 1), secret_value), docs),
            _listed(o["secret"], 2, f"[{q(f.PRIVATE_KEY_VALUE)}]", docs, f"regexp_matches(text, {q(f.PRIVATE_KEY)})"),
            _listed(o["secret"], 3, f"list_filter({all_matches(f.JWT)}, lambda v: {secret_value('v')} and not ({calendar} and strlen(v) < 24))", docs),
        ],
    }


def matches(docs: str, categories=None, phone_locale: str = "other") -> str:
    """Select of ``doc_id, ord, category, pos, value``; ``docs`` is a table or CTE name."""
    chosen = detector_sql(docs, phone_locale)
    selects = [s for c, ss in chosen.items() if categories is None or c in categories for s in ss]
    names = ", ".join(q(c) for c in f.CATEGORIES)
    return (
        f"select doc_id, ord, [{names}][ord] as category, pos, val as value from ("
        "select *, row_number() over (partition by doc_id, ord order by src, ix) - 1 as pos from ("
        + " union all ".join(f"({s})" for s in selects)
        + "))"
    )


def _mask_last(v: str) -> str:
    return (
        f"case when length({v}) <= 4 then repeat('*', greatest(length({v}), 1)) "
        f"else concat(repeat('*', length({v}) - 4), right({v}, 4)) end"
    )


def _mask_prefix(v: str, k: int) -> str:
    return f"concat(left({v}, {k}), repeat('*', greatest(length({v}) - {k}, 0)))"


def redact(c: str, v: str) -> str:
    clean = f"upper(regexp_replace({v}, '[^A-Za-z0-9]', '', 'g'))"
    chars = f"regexp_extract_all({v}, '(?s).')"
    seen = lambda i: f"length(regexp_replace(left({v}, ({i})::int), '[^0-9]', '', 'g'))"
    total = f"length({digits(v)})"
    phone = (
        f"array_to_string(list_transform({chars}, lambda ch, ix: case when not ch between '0' and '9' then ch "
        f"when {total} > 4 and ({seen('ix')} <= 2 or {seen('ix')} > {total} - 2) then ch else '*' end), '')"
    )
    return (
        f"case {c} when 'email' then case when len(string_split({v}, '@')) = 2 then "
        f"concat(left(split_part({v}, '@', 1), 3), '***@', split_part({v}, '@', 2)) else {_mask_prefix(v, 6)} end "
        f"when 'phone' then {phone} "
        f"when 'iban' then case when length({clean}) < 8 then {_mask_prefix(clean, 4)} else "
        f"concat(left({clean}, 4), repeat('*', length({clean}) - 7), right({clean}, 3)) end "
        f"when 'ip_address' then {_mask_prefix(v, 7)} when 'address' then {_mask_prefix(v, 10)} "
        f"when 'postal_code' then {_mask_prefix(v, 2)} when 'date_of_birth' then {_mask_prefix(v, 4)} "
        f"when 'file_name_signal' then {_mask_prefix(v, 12)} when 'weak_archive_encryption' then {v} "
        f"else {_mask_last(v)} end"
    )


def mask_custom(v: str) -> str:
    return _mask_last(v)


def rank_of(level: str) -> str:
    return f"case {level} when 'low' then 0 when 'medium' then 1 when 'high' then 2 when 'critical' then 3 end"


def weight(category: str) -> str:
    return "case " + category + " " + " ".join(f"when {q(c)} then {w}" for c, w in f.WEIGHTS.items()) + " end"


def file_signals(paths: str) -> str:
    """Select of ``doc_id, pos, value, score`` from ``paths(doc_id, path)``."""
    table = ", ".join(f"({i}, {q(k)}, {q(' ' + k.replace('_', ' ') + ' ')}, {s})" for i, (k, s) in enumerate(f.FILE_NAME_KEYWORDS))
    stem = r"regexp_replace(regexp_extract(path, '[^/]+$'), '(?s)^(.+)\.[^.]*$', '\1')"
    ext = r"lower(regexp_extract(regexp_extract(path, '[^/]+$'), '(?s)^.+\.([^.]*)$', 1))"
    return f"""
      select doc_id, k.i as i, k.kw as value, k.score as score
      from (select doc_id, concat(' ', regexp_replace(lower({stem}), '[^a-z0-9]', ' ', 'g'), ' ') as norm from {paths}) p
      join (values {table}) k(i, kw, phrase, score) on contains(p.norm, k.phrase)
      union all
      select doc_id, 999, 'pst', {f.PST_BONUS} from {paths} where {ext} = 'pst'
    """


SUGGESTION = (
    f"case when risk_level in ('high', 'critical') then {q(f.SUGGESTION_HIGH)} "
    f"when risk_level = 'medium' then {q(f.SUGGESTION_MEDIUM)} else {q(f.SUGGESTION_LOW)} end"
)


def risk_report(docs: str, builtin: str, custom: str, bonus: str, rule_levels: dict[str, str]) -> str:
    """Report per document from match selects.

    ``builtin`` gives ``doc_id, ord, category, pos, value``; ``custom`` ``doc_id, category, pos,
    value``; ``bonus`` ``doc_id, i, value, score`` of file names. All are names of CTEs.
    """
    level = (
        "coalesce(case category " + " ".join(f"when {q(n)} then {q(lv)}" for n, lv in rule_levels.items())
        + " end, 'medium')"
        if rule_levels
        else "'medium'"
    )
    return f"""
    found as (
      select doc_id, ord, category, count(*) as cnt,
             category in ('cookie', 'user_id') and
               2 * count(*) filter (where {looks_like_hash('value')}) >= count(*) as hashy,
             array_to_string(list(redacted order by pos) filter (where pos < 5), '|') as ex
      from (select *, {redact('category', 'value')} as redacted from {builtin})
      group by doc_id, ord, category
    ),
    scored as (
      select *, (case when hashy then ({weight('category')}) * 60 // 100 else {weight('category')} end) * least(cnt, 21) as points,
             case when {weight('category')} >= 6 then 2 when {weight('category')} >= 3 then 1 else 0 end as rank
      from found
    ),
    cfound as (
      select doc_id, category, count(*) as cnt, {level} as lvl,
             array_to_string(list({mask_custom('value')} order by pos) filter (where pos < 5), '|') as ex
      from {custom} group by doc_id, category
    ),
    cscored as (
      select *, (case lvl when 'low' then 2 when 'medium' then 4 when 'high' then 7 else 10 end) * least(cnt, 20) as points,
             {rank_of('lvl')} as rank from cfound
    ),
    b as (
      select doc_id, sum(points) as points, max(rank) as rank, count(*) filter (where rank >= 2) as highs,
             string_agg(concat(category, '=', cnt, '[', ex, ']'), ';' order by ord) as findings,
             string_agg(concat(case when hashy then concat('reason.hashLike:', category, ';') else '' end,
                               'reason.categoryCount:', category, ',', cnt), ';' order by ord) as reasons
      from scored group by doc_id
    ),
    c as (
      select doc_id, sum(points) as points, max(rank) as rank, count(*) filter (where rank >= 2) as highs,
             string_agg(concat(category, '=', cnt, '[', ex, ']'), ';' order by category) as findings,
             string_agg(concat('reason.customCategoryCount:', category, ',', cnt, ',', lvl), ';' order by category) as reasons
      from cscored group by doc_id
    ),
    n as (
      select doc_id, sum(score) as bonus,
             string_agg(concat('reason.filenameKeyword:', value), ';' order by i) as reasons
      from {bonus} group by doc_id
    ),
    totals as (
      select d.doc_id, coalesce(b.points, 0) + coalesce(c.points, 0) + coalesce(n.bonus, 0) as risk_score,
             greatest(coalesce(b.rank, 0), coalesce(c.rank, 0)) as max_rank,
             coalesce(b.highs, 0) + coalesce(c.highs, 0) as highs,
             coalesce(b.findings, '') as findings, coalesce(c.findings, '') as custom_findings,
             concat_ws(';', n.reasons, b.reasons, case when n.bonus > 0 then concat('reason.filenameSignal:', n.bonus) end, c.reasons) as reasons
      from {docs} d left join b using (doc_id) left join c using (doc_id) left join n using (doc_id)
    ),
    report as (
      select doc_id, risk_score::bigint as risk_score, findings, custom_findings, reasons,
             ['low', 'medium', 'high', 'critical'][1 + least(max_rank,
               case when risk_score >= 55 and highs >= 2 then 3 when risk_score >= 25 then 2
                    when risk_score >= 10 then 1 else 0 end)] as risk_level
      from totals
    )
    """
