"""Small programs that show the library at work: names(), path(name), and python -m serieslab.demos.NAME SF_DIR."""

from __future__ import annotations

from pathlib import Path

HERE = Path(__file__).parent


def names() -> list[str]:
    return sorted(p.stem for p in HERE.glob("*.py") if p.stem != "__init__")


def path(name: str) -> Path:
    """The file of a demo; an unknown name is an error that lists the others."""
    found = HERE / f"{name}.py"
    if name not in names():
        raise ValueError(f"no demo {name!r}; there are {', '.join(names())}")
    return found
