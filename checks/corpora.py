"""Text corpora derived from the test tables, as SQL that Spark and DuckDB both run.

The documents hold e-mails, addresses, cards and quoted tokens but no bank accounts, wallets,
birth dates and so on. These templates write such values into texts, one text per row of a
whole table.
"""

from __future__ import annotations

_H = "md5(c_custkey::string)"
_NL = "chr(10)"


def _pick(words: list[str], index: str) -> str:
    """One of a few words by a number, without array indexing (which the engines number
    differently)."""
    width = max(len(w) for w in words)
    table = "".join(w.ljust(width) for w in words)
    return f"trim(substr('{table}', (1 + ({index}) % {len(words)} * {width})::int, {width}))"


FIRST = ["John", "Mary", "Pierre", "Anna", "Carlos", "Ingrid", "Hugo", "Chloe"]
LAST = ["Smith", "Martin", "Dupont", "Garcia", "Schmidt", "Rossi", "Jones", "Moreau", "Weber"]
CITY = ["Paris", "Berlin", "Madrid", "London", "New York", "San Jose", "Lyon"]
FIRM = [
    "Acme Corp Inc", "Globex Ltd", "Initech SARL", "Umbrella GmbH", "Stark EURL", "Wayne Holding PLC",
    "Hooli Incredible Ideas", "Vandelay Imports LLC",
]

# bank account number with its check digits: DE, check, 18 digits
_BBAN = "lpad((c_custkey * 7919 % 1000000000)::string, 18, '4')"
_CHECK = f"lpad((98 - cast(concat({_BBAN}, '131400') as decimal(38,0)) % 97)::int::string, 2, '0')"
_IBAN = f"concat('DE', {_CHECK}, {_BBAN})"


def profile_columns() -> dict[str, str]:
    """Expressions over ``customer``: one note per customer with identifiers of all kinds."""
    k = "c_custkey"
    guid = (
        f"concat(substr({_H},1,8),'-',substr({_H},9,4),'-4',substr({_H},14,3),'-a',"
        f"substr({_H},18,3),'-',substr({_H},21,12))"
    )
    ip = f"concat(({k} % 223 + 1)::string,'.',({k} * 7 % 256)::string,'.',({k} * 13 % 256)::string,'.',({k} * 3 % 256)::string)"
    small_ip = f"concat(({k} % 31 + 1)::string,'.',({k} % 7)::string,'.',({k} % 11)::string,'.',({k} % 5)::string)"
    phone = f"concat(case when {k} % 4 = 0 then '0' when {k} % 4 = 1 then '6' else '' end, ({k} * 982451653 % 900000000 + 100000000)::string)"
    card = f"concat('4', lpad((({k} * 982451653 % 1000000007) * 982451 % 1000000000000000)::string, 15, '7'))"
    lines = [
        f"concat('Note for ', c_name)",
        f"concat('contact: ', lower({_pick(FIRST, k)}), ({k} % 100)::string, '@', case {k} % 6 when 0 then 'example.com' when 1 then 'test.com' else 'mail.shop.org' end)",
        f"case when {k} % 2 = 0 then concat('user id: ', {_H}) else concat('UserID=', 'u', ({k} + 100000)::string) end",
        f"concat('session id: ', upper(substr({_H}, 3, 24)))",
        f"case when {k} % 3 = 0 then concat('cookie -> ', substr({_H}, 1, 10), '; sid: s-', {k}::string, '-long') else 'no cookie' end",
        f"concat('adresse: ', ({k} % 200 + 1)::string, case when {k} % 3 = 0 then ' rue Victor Hugo, Paris' when {k} % 3 = 1 then ' Some Street North' else ' nowhere' end)",
        f"concat('code postal: ', ({k} % 90000 + 10000)::string, '.')",
        f"concat(case when {k} % 2 = 0 then 'dob: ' else 'Date of birth is ' end, lpad(({k} % 28 + 1)::string, 2, '0'), '/', lpad(({k} % 12 + 1)::string, 2, '0'), '/', (1950 + {k} % 60)::string)",
        f"concat('account ', case when {k} % 5 = 0 then replace({_IBAN}, 'DE', 'FR') else {_IBAN} end, ' ok')",
        f"concat('api_key = ', case when {k} % 4 = 0 then ({k} + 1000000000)::string else concat('Key-', substr({_H}, 1, 20)) end)",
        f"concat('password: ', substr({_H}, 1, (8 + {k} % 9)::int))",
        f"concat('client secret -> ', case when {k} % 2 = 0 then 'aaaaaaaaaaaaaaaaaaaaaaaaaaaa' else concat('S', {_H}) end)",
        f"case when {k} % 3 = 1 then concat('Authorization: Bearer ', {_H}, '.X') else 'no header' end",
        f"case when {k} % 4 = 2 then concat('jwt eyJ', substr({_H},1,16), '.', substr({_H},4,20), '.', substr({_H},2,12), ' end') else '' end",
        f"case when {k} % 50 = 7 then concat('-----BEGIN RSA PRIVATE KEY-----', {_NL}, {_H}, {_NL}, '-----END RSA PRIVATE KEY-----') else '' end",
        f"case when {k} % 3 = 2 then concat('device id {{', {guid}, '}}') else concat('ref {{', {guid}, '}}') end",
        f"concat('tel {{', {phone}, '}} or ', '06 ', lpad(({k} % 100)::string, 2, '1'), ' 22 39 ', lpad(({k} * 3 % 100)::string, 2, '5'))",
        f"concat('card ', {card}, ' and ', substr({card}, 1, 4), '-', substr({card}, 5, 4), '-', substr({card}, 9, 4), '-', substr({card}, 13, 4))",
        f"concat('from ', {ip}, case when {k} % 2 = 0 then ' see chapter ' else ' gateway ' end, {small_ip})",
        f"case when {k} % 40 = 3 then '<svg>' else '' end",
        f"case when {k} % 60 = 2 then 'BEGIN:VCALENDAR' else '' end",
        f"concat('signed by ', {_pick(FIRST, k)}, ' ', {_pick(LAST, k)}, ' for the company ', {_pick(FIRM, k)}, ' located in ', {_pick(CITY, k)}, ', in the city')",
    ]
    text = f"concat_ws({_NL}, {', '.join(lines)})"
    path = (
        f"concat('/data/u', {k}::string, '/', case {k} % 12 when 0 then 'iban_export.csv' "
        "when 1 then 'CV Resume 2024.txt' when 2 then '.cache/x.txt' when 3 then 'client_secret.json' "
        "when 4 then 'mail.pst' when 5 then 'notes.txt.part' when 6 then 'user_device_technical_id.ics' "
        "when 7 then 'fiche paie rh.log' when 8 then 'passport-scan.PNG' when 9 then 'api_key token.yaml' "
        "when 10 then '../up.txt' else 'plain.html' end)"
    )
    return {"doc_id": k, "path": path, "text": text}


def order_note_columns() -> dict[str, str]:
    """Expressions over ``orders``: one note per order with the values catalog rules look for."""
    k = "o_orderkey"
    h = f"md5({k}::string)"
    d = lambda mul, mod, width: f"lpad(({k} * {mul} % {mod})::string, {width}, '0')"
    mac = ",':',".join(f"substr({h},{i},2)" for i in (1, 3, 5, 7, 9, 11))
    lines = [
        f"case when {k} % 2 = 0 then concat('mac ', {mac}) else concat('cisco ', substr({h},1,4), '.', substr({h},5,4), '.', substr({h},9,4)) end",
        f"case when {k} % 3 = 0 then concat('wallet 0x', {h}, substr({h},1,8)) else concat('wallet 0x', {h}) end",
        f"case when {k} % 3 = 1 then concat('btc 1', substr(replace({h}, '0', 'z'), 1, 30)) else '' end",
        f"concat('ssn ', {d(37, 1000, 3)}, case when {k} % 2 = 0 then '-' else ' ' end, {d(11, 100, 2)}, '-', {d(7919, 10000, 4)})",
        f"case when {k} % 5 = 0 then concat('Passport number: A', {d(104729, 100000000, 8)}) else '' end",
        f"case when {k} % 5 = 1 then concat('nhs number: ', {d(31, 1000, 3)}, ' ', {d(17, 1000, 3)}, ' ', {d(7919, 10000, 4)}) else '' end",
        f"case when {k} % 4 = 0 then concat('NIR: 1', {d(7919, 100000000000000, 14)}) else '' end",
        f"case when {k} % 4 = 1 then concat('TVA FR: FR4', ({k} % 10)::string, {d(104729, 1000000000, 9)}) else '' end",
        f"concat('DNI ', {d(7919, 100000000, 8)}, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (1 + {k} % 26)::int, 1))",
        f"concat('Steuer-ID: ', {d(7919, 100000000000, 11)})",
        f"concat('badge_no = ', o_orderpriority, ' / clerk.ref-> ', substr({h}, 1, 6))",
    ]
    return {"doc_id": k, "text": f"concat_ws({_NL}, {', '.join(lines)})"}


def select(columns: dict[str, str], table: str) -> str:
    return "select " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + f" from {table}"


def profiles() -> str:
    return select(profile_columns(), "customer")


def order_notes() -> str:
    return select(order_note_columns(), "orders")
