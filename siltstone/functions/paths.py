"""Paths of files as they are named on different systems."""

from __future__ import annotations

import re


def forward(path: str) -> str:
    return path.replace("\\", "/")


def is_absolute(path: str) -> bool:
    """From a root, or from a drive."""
    return path.startswith("/") or re.match("[A-Za-z]:", path) is not None


def within(path: str, root: str) -> str | None:
    """What comes after root; empty for root itself, None for a path elsewhere or an empty root."""
    if not root:
        return None
    path, base = forward(path), forward(root)
    if path == base:
        return ""
    base = base if base.endswith("/") else base + "/"
    return path[len(base) :] if path.startswith(base) else None


def resolved(*parts: str) -> str:
    """The parts one after the other, an absolute one starting anew, without . and .. steps."""
    whole = ""
    for p in map(forward, parts):
        whole = p if is_absolute(p) or not whole else f"{whole}/{p}"
    drive = m[0] if (m := re.match("[A-Za-z]:", whole)) else ""
    out: list[str] = []
    for step in whole[len(drive) :].split("/"):
        if step == "..":
            out[-1:] = []
        elif step not in ("", "."):
            out.append(step)
    return f"{drive}/" + "/".join(out) if drive or whole.startswith("/") else "/".join(out)
