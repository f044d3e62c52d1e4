"""Layered rule catalogs as a DataFrame."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..catalog import shipped


def _definition(rule: tuple, **more: Any) -> dict[str, Any]:
    rule_id, category, risk, locale, field, value = rule
    custom = rule_id in shipped.CUSTOM_KEY_LABELS
    return {
        "id": rule_id,
        "display_name_key": "custom.test" if custom else f"entities.types.{rule_id}",
        "description_key": "custom.desc.test" if custom else f"entities.descriptions.{rule_id}",
        "category": category,
        "risk_level": risk,
        "requires_key": custom,
        "key_labels": shipped.CUSTOM_KEY_LABELS.get(rule_id, []),
        "enabled": True,
        "locale_requirement": locale,
        "field_name_regex": field,
        "value_regex": value,
        **more,
    }


def base_definitions() -> list[dict[str, Any]]:
    builtin = [
        {
            "id": i,
            "display_name_key": display,
            "description_key": f"types.desc.{i}",
            "category": category,
            "risk_level": risk,
            "requires_key": i == "secret",
            "key_labels": shipped.SECRET_KEY_LABELS if i == "secret" else [],
            "enabled": True,
            "advanced": {
                "blocked_extensions": shipped.SECRET_BLOCKED_EXTENSIONS if i == "secret" else [],
                "filename_keywords": [
                    {"keyword": k, "score": s} for k, s in shipped.FILE_NAME_KEYWORD_SCORES.items()
                ]
                if i == "file_name_signal"
                else [],
            },
        }
        for i, display, category, risk in shipped.BUILTIN_TYPES
    ]
    return builtin + [_definition(r) for r in shipped.BASE_RULES]


def locale_candidates(locale: str) -> list[str]:
    """Names under which a locale's catalog may be filed, most exact first."""
    name = locale.strip().split(".")[0].split("@")[0]
    if not name:
        return []
    cut = name.find("_") if "_" in name else name.find("-")
    lang = name[:cut] if cut >= 0 else name
    return [c for c in dict.fromkeys([name, name.lower(), lang, lang.lower()]) if c]


def parse_catalog(text: str) -> list[dict[str, Any]]:
    """Definitions of one catalog document: ``{"types": [...]}`` in YAML or JSON."""
    try:
        import yaml
    except ImportError:
        document = json.loads(text)
    else:
        document = yaml.safe_load(text)
    types = document["types"]
    for t in types:
        if t["risk_level"] not in ("low", "medium", "high", "critical"):
            raise ValueError(f"{t['id']}: unknown risk level {t['risk_level']}")
    return types


def _read_layer(spark: SparkSession, path: str) -> list[dict[str, Any]] | None:
    """Definitions of a catalog file on any file system Spark reads; None when it is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return parse_catalog(spark.read.text(path, wholetext=True).first()["value"])


def _row(definition: dict[str, Any], layer: int, origin: str) -> dict[str, Any]:
    advanced = definition.get("advanced") or {}
    row = {f.name: definition.get(f.name) for f in schemas.RULES.fields}
    row.update(
        key_labels=definition.get("key_labels") or [],
        blocked_extensions=advanced.get("blocked_extensions") or [],
        filename_keywords={
            k["keyword"]: int(k["score"]) for k in advanced.get("filename_keywords") or []
        },
        threshold=None if definition.get("threshold") is None else float(definition["threshold"]),
        layer=layer,
        origin=origin,
    )
    return row


def load_rules(
    spark: SparkSession,
    locale: str | None = "",
    *,
    layers: Iterable[tuple[str, list[dict[str, Any]]]] = (),
    user_file: str | None = None,
    host_file: str | None = None,
) -> DataFrame:
    """The rule table: shipped base, locale and locale-custom layers, then extra ``layers``,
    the user's file and the host's file. For each id the last layer wins.

    A missing file is skipped. A broken user or host file is a warning, anything else an error.
    """
    stack: list[tuple[str, list[dict[str, Any]]]] = [("standard/base", base_definitions())]
    for name in locale_candidates(locale or ""):
        stack.append(
            ("standard/locale", [_definition(r) for r in shipped.LOCALE_RULES.get(name, [])])
        )
        stack.append(
            ("custom", [_definition(r) for r in shipped.LOCALE_CUSTOM_RULES.get(name, [])])
        )
    stack.extend(layers)
    for origin, path in (("custom", user_file), ("host", host_file)):
        if path is None:
            continue
        try:
            found = _read_layer(spark, path)
        except Exception as error:  # noqa: BLE001 - a broken optional layer must not stop a scan
            warnings.warn(f"rule catalog {path} ignored: {error}", stacklevel=2)
            continue
        if found is not None:
            stack.append((origin, found))
    # configuration: resolved here, so that the rules of a plan cost no job
    rows = {
        definition["id"]: _row(definition, layer, origin)
        for layer, (origin, definitions) in enumerate(stack)
        for definition in definitions
    }
    return spark.createDataFrame(list(rows.values()), schemas.RULES)
