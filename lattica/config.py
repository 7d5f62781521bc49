"""Settings with defaults that the environment may override."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class Settings:
    """Limits of hosted completions and shares of the record categories."""

    concurrent: int = 15
    requests_per_minute: int = 100
    tokens_per_minute: int = 80_000
    retries: int = 5
    seed: int = 42

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, prefix: str = "LATTICA_") -> Settings:
        """Defaults, replaced by PREFIX + the field's name in capitals where that is set."""
        env = os.environ if env is None else env
        return cls(**{f.name: int(env[prefix + f.name.upper()]) for f in dataclasses.fields(cls) if env.get(prefix + f.name.upper())})
