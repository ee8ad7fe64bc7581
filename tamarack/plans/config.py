"""Configuration files that extend one another, and the placeholders left in them."""

from __future__ import annotations

from pathlib import Path

import yaml

from ..errors import ManifestError

#: Fixed value: what stands where a setting is still to be filled in.
FILL = "FILL_ME"


def lineage(path: str | Path) -> list[dict]:
    """The mappings of a file and all it extends, the furthest first; anything but a mapping, or a circle, is an error."""
    found: list[dict] = []
    seen: set[Path] = set()
    here: Path | None = Path(path).resolve()
    while here is not None:
        if here in seen:
            raise ManifestError(f"{here} extends itself")
        seen.add(here)
        content = yaml.safe_load(here.read_text(encoding="utf-8"))
        if not isinstance(content, dict):
            raise ManifestError(f"{here} holds no mapping")
        found.insert(0, {k: v for k, v in content.items() if k != "extends"})
        above = content.get("extends")
        here = (here.parent / above).resolve() if above else None
    return found


def load_config(path: str | Path) -> dict:
    """A YAML file over those it extends: settings are laid by their place, so a mapping adds to the one below it and any other value replaces it."""
    whole: dict = {}
    for layer in lineage(path):
        open_ = [(whole, layer)]
        while open_:
            below, above = open_.pop()
            for key, value in above.items():
                if isinstance(value, dict):
                    if not isinstance(below.get(key), dict):
                        below[key] = {}
                    open_.append((below[key], value))
                else:
                    below[key] = value
    return whole


def unresolved(config) -> list[str]:
    """Places (``a.b[0]``) of a configuration that still hold the placeholder, in its order."""
    found, open_ = [], [("", config)]
    while open_:
        place, value = open_.pop()
        if value == FILL:
            found.append(place)
        elif isinstance(value, dict):
            open_ += [(f"{place}.{k}".lstrip("."), v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            open_ += [(f"{place}[{i}]", value[i]) for i in range(len(value) - 1, -1, -1)]
    return found
