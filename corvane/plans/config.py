"""The configuration of a workspace."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from corvane.operators.health import Weights


@dataclass(frozen=True)
class Config:
    """Weights of the score, and paths to leave out beyond those of ignore files."""

    health: Weights = field(default_factory=Weights)
    ignore: tuple[str, ...] = ()

    @classmethod
    def load(cls, root: str, folder: str = ".corvane") -> Config:
        """Reads ``config.toml`` in the workspace's folder; without it, defaults.  A broken file is an error."""
        path = os.path.join(root, folder, "config.toml")
        if not os.path.exists(path):
            return cls()
        with open(path, "rb") as f:
            doc = tomllib.load(f)
        known = {w.name for w in fields(Weights)}
        return cls(Weights(**{k: float(v) for k, v in doc.get("health", {}).items() if k in known}), tuple(doc.get("ignore", ())))
