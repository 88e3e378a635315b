"""Settings of a detection run: an immutable value that is passed explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Settings:
    """Defaults as a library call has them; ``for_cli`` has the command line's."""

    ruleset: str = "default"
    k: int = 3
    num_perm: int = 128
    min_lines: int = 5
    similarity: float = 0.8
    ignore_patterns: tuple[str, ...] = ()
    ignore_files: tuple[str, ...] = ("**/.*ignore",)
    region_filters: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    additional_regions: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    excluded_regions: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    signature_ratio: float = 0.98

    def __post_init__(self) -> None:
        for name in ("k", "num_perm", "min_lines"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 0 < self.similarity <= 1:
            raise ValueError("similarity must lie in (0, 1]")

    @property
    def lsh_threshold(self) -> float:
        return min(0.5, 0.7 * self.similarity)

    @property
    def pair_threshold(self) -> float:
        return 0.8 * self.similarity

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Settings with the environment's overlay."""
        names = {"RULES_RULESET": ("ruleset", str), "SHINGLE_K": ("k", int), "MINHASH_NUM_PERM": ("num_perm", int), "LSH_MIN_LINES": ("min_lines", int), "LSH_SIMILARITY_PERCENT": ("similarity", float)}
        return replace(cls(), **{f: kind(env[key]) for key, (f, kind) in names.items() if key in env})

    @classmethod
    def for_cli(cls, similarity_percent: int = 100, **kw) -> Settings:
        """The command line states per cent (5 to 100) and defaults to 100."""
        if not 5 <= similarity_percent <= 100:
            raise ValueError("similarity must lie between 5 and 100 per cent")
        kw = {k: v for k, v in kw.items() if k in {f.name for f in fields(cls)}}
        return replace(cls.from_env(), similarity=similarity_percent / 100, **kw)
