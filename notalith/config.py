"""Settings from a file: an explicit path, then the environment, then upward from here, then home."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

NAME = ".notalith.json"
VARIABLE = "NOTALITH_CONFIG"


def find_config(explicit: str | None = None, start: str | None = None) -> Path | None:
    if explicit:
        path = Path(explicit)
        if not path.exists():
            raise FileNotFoundError(path)
        return path
    if os.environ.get(VARIABLE):
        return Path(os.environ[VARIABLE])
    here = Path(start or ".").resolve()
    return next((p for p in (*(d / NAME for d in (here, *here.parents)), Path.home() / NAME) if p.exists()), None)


def load_config(path: Path | None) -> dict:
    """Settings by snake-case name; keys may be written with hyphens or in camel case."""
    if path is None:
        return {}
    found = json.loads(path.read_text())
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no object of settings")
    return {re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", k).replace("-", "_").lower(): v for k, v in found.items()}


def with_defaults(given: dict, config: dict) -> dict:
    """What was given, and the file's settings for the rest."""
    return config | {k: v for k, v in given.items() if v is not None}
