"""Shipped rule catalog.

The table is a FIXED VALUE: identifiers, levels, locales and patterns decide what is found.
"""

from __future__ import annotations

# id, category, risk level, locale requirement, field-name pattern, value pattern
BASE_RULES = [
    ("mac_address", "security", "low", None, None,
     r"(?i)\b(?:(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}|[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4})\b"),
    ("organization", "pii", "low", None, None, r"a^"),
    ("bitcoin", "pii", "medium", None, None,
     r"\b(?:bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"),
    ("ethereum", "pii", "medium", None, None, r"(?i)\b0x[a-f0-9]{40}\b"),
    ("us_ssn", "pii", "high", "en-US", None, r"\b\d{3}[ .-]?\d{2}[ .-]?\d{4}\b"),
    ("us_passport", "pii", "high", "en-US",
     r"(?i)\b(passport|passport[_\s-]*(number|no|id)|us[_\s-]*passport)\b", r"\b[A-Z]\d{8}\b"),
    ("us_itin", "pii", "high", "en-US", None, r"\b9\d{2}[ -]?\d{2}[ -]?\d{4}\b"),
    ("uk_nhs", "pii", "high", "en-GB", r"(?i)\b(nhs|nhs[_\s-]*number)\b",
     r"\b\d{3}[ -]?\d{3}[ -]?\d{4}\b"),
    ("uk_nino", "pii", "high", "en-GB", None,
     r"(?i)\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]?\b"),
    ("es_dni", "pii", "high", "es", None, r"\b\d{7,8}-?[A-HJ-NP-TV-Z]\b"),
    ("es_nie", "pii", "high", "es", None, r"(?i)\b[XYZ]\d{7}[A-Z]\b"),
    ("es_cif", "pii", "high", "es", None, r"(?i)\b[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]\b"),
    ("de_tax_id", "pii", "high", "de", None, r"\b[1-9]\d{10}\b"),
    ("de_vat", "pii", "high", "de", None, r"(?i)\bDE\d{9}\b"),
]
LOCALE_RULES = {
    "fr": [
        ("fr_nir", "pii", "critical", "fr", None, r"\b[12]\d{14}\b"),
        ("fr_tva", "pii", "high", "fr", None, r"(?i)\bFR[0-9A-Z]{2}\d{9}\b"),
    ],
}
LOCALE_CUSTOM_RULES = {
    "fr": [("custom_test", "security", "high", None, None, None)],
}
CUSTOM_KEY_LABELS = {"custom_test": ["mon_secret"]}

# id, display key, category, risk level of the built-in categories (no patterns: metadata)
BUILTIN_TYPES = [
    ("email", "pii.email", "pii", "medium"),
    ("phone", "pii.phone", "pii", "medium"),
    ("iban", "pii.iban", "pii", "high"),
    ("credit_card", "pii.creditCard", "pii", "high"),
    ("ip_address", "pii.ipAddress", "security", "low"),
    ("address", "pii.address", "pii", "medium"),
    ("postal_code", "pii.postalCode", "pii", "medium"),
    ("date_of_birth", "pii.dateOfBirth", "pii", "high"),
    ("cookie", "pii.cookie", "pii", "medium"),
    ("user_id", "pii.userId", "pii", "medium"),
    ("secret", "pii.secret", "security", "high"),
    ("weak_archive_encryption", "pii.weakArchiveEncryption", "security", "high"),
    ("file_name_signal", "pii.fileNameSignal", "pii", "low"),
]
SECRET_KEY_LABELS = [
    "api_key", "x-api-key", "client_secret", "access_token", "private_key", "bearer_token",
]
SECRET_BLOCKED_EXTENSIONS = ["ics", "ical", "calendar", "excalidraw", "txt"]
FILE_NAME_KEYWORD_SCORES = {
    "secret": 5, "token": 5, "password": 6, "client_secret": 8, "api_key": 8, "access_token": 8,
}
