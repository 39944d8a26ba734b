"""Policies: a versioned YAML file and its field schema, read on the driver into frozen records."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from typing import Any


class ConfigError(ValueError):
    """A policy or schema that can't be used."""


@dataclass(frozen=True)
class Field:
    id: str
    type: str
    required: bool = False


@dataclass(frozen=True)
class Naming:
    template: str = "{invoice_date}_{organization_slug}_{document_type}_{invoice_number}.{extension}"
    max_length: int = 180
    component_max_length: int = 60
    collision_strategy: str = "content_hash_suffix"
    unsafe_chars: str = '[<>:"/\\\\|?*\\x00-\\x1f]'
    reserved_names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Category:
    id: str
    destination: str
    when: str


@dataclass(frozen=True)
class Thresholds:
    auto_apply: float = 0.94
    manual_review: float = 0.75
    ocr_min_coverage: float = 0.30
    ocr_min_confidence: float = 60.0


@dataclass(frozen=True)
class Policy:
    policy_version: str
    schema_version: str
    document_type: str = "unknown"
    fields: tuple[Field, ...] = ()
    naming: Naming = field(default_factory=Naming)
    categories: tuple[Category, ...] = ()
    thresholds: Thresholds = field(default_factory=Thresholds)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(f.id for f in self.fields if f.required)


# Types of fields and documents, and the shipped policy.
FIELD_TYPES = ("string", "date", "decimal", "currency", "organization")
DOCUMENT_TYPES = ("invoice", "receipt", "credit_note", "purchase_order", "statement", "proof_of_payment", "unknown")
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
DEFAULT = Policy(
    policy_version="default-v1",
    schema_version="invoice-v1",
    document_type="invoice",
    fields=(
        Field("invoice_number", "string", True), Field("organization_name", "organization", True), Field("invoice_date", "date", True),
        Field("total_amount", "decimal", True), Field("currency", "currency", True), Field("purchase_order_number", "string"),
        Field("due_date", "date"), Field("vat_number", "string"), Field("recipient_organization", "organization"),
    ),
    naming=Naming(reserved_names=RESERVED),
    categories=tuple(
        Category(i, f"Finance/{folder}/{{invoice_date_year}}/{{invoice_date_month}}", f"document_type == '{t}'")
        for i, folder, t in (
            ("supplier_invoices", "Invoices", "invoice"), ("credit_notes", "CreditNotes", "credit_note"), ("receipts", "Receipts", "receipt"),
            ("statements", "Statements", "statement"), ("proof_of_payment", "ProofOfPayment", "proof_of_payment"),
        )
    ),
)


def _mapping(path: str) -> dict[str, Any]:
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except OSError as e:
        raise ConfigError(f"{path}: {e.strerror}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} isn't YAML: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path} holds no mapping")
    return data


def _need(data: dict[str, Any], key: str, where: str) -> Any:
    if key not in data:
        raise ConfigError(f"{where} has no {key}")
    return data[key]


def load(path: str, schema_path: str | None = None) -> Policy:
    """The policy of a YAML file. Its schema is <folder above>/schemas/<schema_version>.yaml unless it is named."""
    data = _mapping(path)
    version = str(_need(data, "schema_version", path))
    schema_path = schema_path or os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(path))), "schemas", f"{version}.yaml")
    schema = _mapping(schema_path)
    fields = []
    for row in _need(schema, "fields", schema_path):
        kind = str(_need(row, "type", schema_path))
        if kind not in FIELD_TYPES:
            raise ConfigError(f"{schema_path}: unknown field type {kind!r}")
        fields.append(Field(str(_need(row, "id", schema_path)), kind, bool(row.get("required", False))))
    document_type = str(schema.get("document_type", "unknown"))
    if document_type not in DOCUMENT_TYPES:
        raise ConfigError(f"{schema_path}: unknown document type {document_type!r}")
    naming, limits = data.get("naming") or {}, data.get("thresholds") or {}
    known = {k: tuple(map(str, v)) if k == "reserved_names" else v for k, v in naming.items() if k in Naming.__dataclass_fields__}
    rules = tuple(Category(*(str(_need(r, k, path)) for k in ("id", "destination", "when"))) for r in data.get("categories") or [])
    return Policy(
        policy_version=str(_need(data, "policy_version", path)), schema_version=version, document_type=document_type, fields=tuple(fields),
        naming=replace(Naming(), **known), categories=rules,
        thresholds=replace(Thresholds(), **{k: float(v) for k, v in limits.items() if k in Thresholds.__dataclass_fields__}),
    )
