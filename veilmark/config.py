"""Job options and the policy sets derived from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from veilmark.functions import patterns as P


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    """Everything a job needs to know apart from its input.

    ``company_terms`` is a list, or a DataFrame with a ``term`` column.  ``roster`` is a
    DataFrame with ``full_name`` and optionally ``email``, ``username`` and ``pos``.
    ``lexicon`` is a DataFrame ``(term, etype)`` for names, organisations and places.
    ``ner`` maps a text column to an array of spans (see :mod:`veilmark.functions.spans`)
    and is the place for a user's own model, usually a pandas UDF.

    ``exclude_terms`` and ``subject_values`` are lists, or DataFrames with a ``term`` or ``value`` column
    of any size.  ``domain_suffixes`` is a DataFrame with a ``suffix`` column (``com``, ``co.uk``), for
    instance the public suffix list, and replaces the built-in endings of domains.
    """

    company_terms: Sequence[str] | DataFrame = ()
    roster: DataFrame | None = None
    lexicon: DataFrame | None = None
    ner: Callable[[Column], Column] | None = None
    rules: Sequence[P.PatternRule] = ()
    exclude_terms: Sequence[str] | DataFrame = ()
    passthrough_types: Sequence[str] = ()
    masking_rules: dict = field(default_factory=dict)
    redact_profiles: dict = field(default_factory=dict)
    mask: bool = False
    redact: bool = False
    subject_values: Sequence[str] | DataFrame = ()
    domain_suffixes: DataFrame | None = None
    anchor_field: str | None = None
    correlated_fields: Sequence[str] = ()
    force_fields: Sequence[str] = ()
    word_boundary: bool = False
    # Physical bounds; see README, "Sizes".
    small_dictionary_terms: int = 64
    dictionary_chars: int = 4_000_000
    broadcast_bytes: int = 32 << 20
    single_task_rows: int = 1_000_000

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    @property
    def entity_types(self) -> tuple[str, ...]:
        return P.STANDARD_TYPES + (P.REDACT_ONLY_TYPES if self.redact else ())

    @property
    def active_masks(self) -> dict:
        return dict(self.masking_rules) if self.mask else {}

    @property
    def dropped_types(self) -> frozenset[str]:
        """Types that stay visible: the wanted ones minus the protected ones."""
        protected = P.PROTECTED_RELAXED if self.redact else P.PROTECTED_STRICT
        return frozenset(self.passthrough_types) - protected

    @property
    def subject_keys(self) -> tuple[str, ...]:
        if isinstance(self.subject_values, DataFrame):
            return ()
        return tuple(sorted({v.strip().lower() for v in self.subject_values}))

    @property
    def excluded_keys(self) -> tuple[str, ...]:
        if isinstance(self.exclude_terms, DataFrame):
            return ()
        return tuple(sorted({t.lower() for t in self.exclude_terms}))

    @property
    def by_tables(self) -> bool:
        """Whether a policy or the domain endings come as a table, so that spans meet it in a join."""
        return self.domain_suffixes is not None or any(
            isinstance(v, DataFrame) for v in (self.exclude_terms, self.subject_values)
        )


def passthrough_for_tokens(configured: Iterable[str], extra: Iterable[str] = ()) -> frozenset[str]:
    """Configured types and call arguments together, minus the protected types."""
    return (frozenset(configured) | frozenset(extra)) - P.PROTECTED_STRICT


def redact_profile(settings: Settings, name: str) -> dict:
    profiles = settings.redact_profiles
    if name not in profiles:
        known = ", ".join(profiles) or "(none)"
        raise SettingsError(f"unknown redact profile {name!r}; available: {known}")
    return profiles[name] or {}


def passthrough_for_redact(
    settings: Settings, profile: str | None = None, extra: Iterable[str] = ()
) -> frozenset[str]:
    """Types of a profile and call arguments; only card numbers stay protected.

    The general ``passthrough_types`` are not merged in: they belong to token jobs.
    """
    wanted = set(redact_profile(settings, profile).get("passthrough", ())) if profile else set()
    return frozenset(t.upper() for t in wanted | set(extra)) - P.PROTECTED_RELAXED


def for_redact(settings: Settings, profile: str | None = None, extra: Iterable[str] = ()) -> Settings:
    """Settings of a one-time redaction: masks on, all 13 types, relaxed protection."""
    return settings.with_(
        mask=True,
        redact=True,
        masking_rules=settings.masking_rules or P.MASK_DEFAULTS,
        passthrough_types=tuple(passthrough_for_redact(settings, profile, extra)),
    )


def for_dsar(settings: Settings, subject: dict) -> Settings:
    """Settings of a subject access request: masks on, nothing passes, subject exempt."""
    from veilmark.operators.subject import subject_values

    return settings.with_(
        mask=True,
        redact=False,
        masking_rules=settings.masking_rules or P.MASK_DEFAULTS,
        passthrough_types=(),
        subject_values=tuple(subject_values(subject)),
    )
