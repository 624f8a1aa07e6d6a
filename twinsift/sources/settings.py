"""Settings of a scan from TOML files."""

from __future__ import annotations

import tomllib
from pathlib import Path

SECTION = "twinsift"
DEFAULTS = {"threshold": 0.9, "min_lines": 8, "min_tokens": 15, "exclude": [], "notebooks": False, "linkage": "single"}


def load_section(path: str, section: str = SECTION) -> dict:
    """[tool.<section>] or [<section>] of a file, or a file of settings without a header; {} if it is missing or no TOML."""
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    found = data.get("tool", {}).get(section) or data.get(section)
    if isinstance(found, dict):
        return found
    return data if data.keys() & DEFAULTS.keys() else {}


def load_settings(folder: str, path: str | None = None) -> dict:
    """Defaults under the first that has any: the given file alone, else pyproject.toml, else .twinsift.toml."""
    names = [path] if path else [str(Path(folder, n)) for n in ("pyproject.toml", f".{SECTION}.toml")]
    return DEFAULTS | next(filter(None, map(load_section, names)), {})


def init_settings(folder: str) -> str:
    """Appends the defaults to pyproject.toml, or to a new .twinsift.toml where there is none; a file that has them stays."""
    project = Path(folder, "pyproject.toml")
    target = project if project.exists() else Path(folder, f".{SECTION}.toml")
    if not load_section(str(target)):
        show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
        head = f"[tool.{SECTION}]" if target == project else f"[{SECTION}]"
        with target.open("a", encoding="utf-8") as out:
            out.write("\n".join(["", head, *(f"{k} = {show(v)}" for k, v in DEFAULTS.items()), ""]))
    return str(target)
