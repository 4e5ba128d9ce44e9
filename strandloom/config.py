"""Parameters of the operators, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrimConf:
    """Quality trimming: least base quality, least mean quality, least length."""

    min_phred: int = 20
    min_mean: int = 20
    min_size: int = 25
    enabled: bool = True

    def __post_init__(self):
        if min(self.min_phred, self.min_mean, self.min_size) < 0:
            raise ValueError("trimming limits can't be negative")


@dataclass(frozen=True)
class SearchConf:
    """Approximate search: a fixed number of errors, or one for every `errors_rate` bases; strata beyond the best; indels; one gap."""

    errors: int = 0
    auto_errors: bool = False
    errors_rate: int = 15
    delta: int = 0
    indels: bool = False
    indels_max: int = 5
    gap: bool = False
    max_gap: int = 100
    seed_size: int = 20
    seed_errors: int = 1
    bisulfite: bool = False
    print_first: int | None = 1

    def __post_init__(self):
        if self.errors < 0 or self.delta < 0 or self.errors_rate <= 0 or self.indels_max < 0 or self.max_gap < 0:
            raise ValueError("search limits can't be negative, and errors_rate is positive")
        if self.indels and self.gap:
            raise ValueError("choose indels or gap")
        if self.print_first is not None and self.print_first < 1:
            raise ValueError("print_first is at least 1")


@dataclass(frozen=True)
class PairConf:
    """Limits of the insert size; None is no limit."""

    insert_min: int | None = None
    insert_max: int | None = None

    def __post_init__(self):
        if self.insert_min is not None and self.insert_max is None:
            raise ValueError("a least insert size needs a greatest one")
        if self.insert_max is not None and (self.insert_min or 0) > self.insert_max:
            raise ValueError("the least insert size is above the greatest")


@dataclass(frozen=True)
class MethylConf:
    """Methylation: coverage that decides, how far it may fall, threshold of coverage, greatest mean distance."""

    min_cov: int = 10
    max_cov: int = 20
    coverage_threshold: int = 1
    error_threshold: float = 1.0
    saturation: int = 255

    def __post_init__(self):
        if not 0 < self.min_cov <= self.max_cov:
            raise ValueError("min_cov is positive and at most max_cov")
        if not 0 <= self.error_threshold <= 1:
            raise ValueError("error_threshold is a share")
