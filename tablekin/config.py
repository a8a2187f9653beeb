"""Thresholds, weights and switches of discovery."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Thresholds.
OVERLAP_HIGH = 0.98
OVERLAP_MEDIUM = 0.80
NAME_HIGH = 0.85
NAME_WEAK = 0.72
DISTRIBUTION_HIGH = 0.90
DISTRIBUTION_MEDIUM = 0.75
NULL_PATTERN = 0.80
FORMAT_SHARE = 0.80
PRIVATE_SHARE = 0.80
HIGH = 0.85
MEDIUM = 0.55
LOW_CAP = 0.54
VETO_BELOW = 0.5
NEAR_BEST = 0.05
UNKNOWN_WEIGHT = 0.1

# The weight of each signal.
WEIGHTS = {
    "naming_exact": 1.00,
    "naming_role": 0.90,
    "naming_self": 0.90,
    "cardinality_match": 0.95,
    "overlap_high": 0.90,
    "name_identical": 0.60,
    "name_sim": 0.60,
    "overlap_medium": 0.55,
    "dist_high": 0.50,
    "format_match": 0.40,
    "dist_med": 0.30,
    "name_sim_weak": 0.25,
    "null_corr": 0.20,
}

# What a link whose heaviest signal this is counts as detected by.
LABELS = {
    "naming_exact": "naming",
    "naming_role": "naming",
    "naming_self": "naming",
    "name_identical": "name_similarity",
    "name_sim": "name_similarity",
    "name_sim_weak": "name_similarity",
    "overlap_high": "value_overlap",
    "overlap_medium": "value_overlap",
    "cardinality_match": "cardinality",
    "format_match": "format",
    "dist_high": "distribution",
    "dist_med": "distribution",
    "null_corr": "null_pattern",
}

STRONG_NAMES = ("naming_exact", "naming_role", "naming_self")
CLOSE_NAMES = ("name_identical", "name_sim")
VALUE_FITS = ("cardinality_match", "overlap_high")

# Formats in the order in which they are tried; without regard to case.
FORMATS = [
    ("uuid", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("iso_ts", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"),
    ("iso_date", r"^\d{4}-\d{2}-\d{2}$"),
    ("zip_us", r"^\d{5}(-\d{4})?$"),
    ("phone", r"^\+?[\d\s\-().]{7,15}$"),
    ("hex_color", r"^#[0-9a-fA-F]{3,6}$"),
    ("int_code", r"^\d{1,6}$"),
    ("alpha_code", r"^[A-Z]{2,4}$"),
]

# Value patterns of personal data; case matters.
PRIVATE_VALUES = [
    ("email addresses", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("phone numbers", r"^(\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}$"),
    ("social security numbers", r"^\d{3}-\d{2}-\d{4}$"),
]


@dataclass(frozen=True)
class Switches:
    """Which signals a scan uses."""

    naming: bool = True
    value_overlap: bool = True
    cardinality: bool = True
    format: bool = True
    distribution: bool = True
    null_pattern: bool = False

    @property
    def content(self) -> bool:
        return self.value_overlap or self.cardinality or self.format or self.distribution

    @classmethod
    def of(cls, method: str = "both", naming_only: bool = False, **changed: bool) -> Switches:
        """From a method (naming, content, both, manual) and single switches; naming_only turns all content off."""
        if method not in ("naming", "content", "uniqueness", "both", "all", "manual"):
            raise ValueError(f"unknown method {method!r}")
        names = method in ("naming", "both", "all")
        values = method in ("content", "uniqueness", "both", "all") and not naming_only
        base = cls(names, values, values, values, values, False)
        return replace(base, **{k: v and (values if k != "naming" else names) for k, v in changed.items()})


@dataclass(frozen=True)
class Options:
    """Parameters of a scan. `max_pairs` None compares all pairs; `order_column` gives row positions to null_pattern."""

    method: str = "both"
    min_confidence: str = "medium"
    switches: Switches | None = None
    max_pairs: int | None = None
    max_columns: int | None = None
    order_column: str | None = None

    def active(self) -> Switches:
        return self.switches or Switches.of(self.method)


def tier(score: float) -> str:
    return "high" if score >= HIGH else "medium" if score >= MEDIUM else "low"


RANK = {"low": 0, "medium": 1, "high": 2}
