"""Which revision of a tree an index was built from."""

from __future__ import annotations

import subprocess


def _git(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=True)
    except (OSError, subprocess.SubprocessError):
        return ""
    return done.stdout.strip()


def resolve_ref(root: str, named: str | None = None) -> str:
    """A given name, else the exact tag, the branch, the short revision, or "unknown"."""
    if named:
        return named
    if tag := _git(root, "describe", "--tags", "--exact-match"):
        return tag
    branch = _git(root, "rev-parse", "--abbrev-ref", "HEAD")
    if branch and branch != "HEAD":
        return branch
    return _git(root, "rev-parse", "--short", "HEAD") or "unknown"


def revision(root: str) -> str | None:
    return _git(root, "rev-parse", "HEAD") or None
