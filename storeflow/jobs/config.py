"""Job configuration files."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str) -> dict:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise ValueError("no YAML reader is installed: give the configuration as JSON") from error
        return yaml.safe_load(text)
    return json.loads(text)
