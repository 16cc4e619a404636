"""Pseudonymisation of text and tables as Spark jobs."""

from veilmark.config import Settings
from veilmark.plans.jobs import (
    TableInput,
    TextInput,
    audit,
    dsar_table,
    dsar_text,
    pseudonymise_table,
    pseudonymise_tables,
    pseudonymise_text,
    redact_folder,
    redact_table,
    redact_text,
    restore,
    run,
)

__all__ = [
    "Settings",
    "TableInput",
    "TextInput",
    "audit",
    "dsar_table",
    "dsar_text",
    "pseudonymise_table",
    "pseudonymise_tables",
    "pseudonymise_text",
    "redact_folder",
    "redact_table",
    "redact_text",
    "restore",
    "run",
]
