"""Changed files as git lists them."""

from __future__ import annotations

import os
import re
import subprocess

_BRANCH = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9\-_./]*")


def safe_branch(name: str) -> str:
    """A branch name that can stand in a command; empty means main."""
    if not name:
        return "main"
    if not _BRANCH.fullmatch(name) or any(c in name for c in ";|&$`<>(){}[]!*?~\n\r\\"):
        raise ValueError(f"not a branch name: {name!r}")
    return name


def lines(output: str) -> list[str]:
    output = output.rstrip("\n")
    return output.split("\n") if output else []


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, check=True).stdout


def is_repository(path: str) -> bool:
    return os.path.exists(os.path.join(path, ".git"))


def changed_files(root: str, base: str = "") -> list[str]:
    """Files that differ from where the branch left base; where that fails, from base itself."""
    base = safe_branch(base)
    try:
        return lines(_git(root, "diff", "--name-only", f"{base}...HEAD"))
    except subprocess.CalledProcessError:
        return lines(_git(root, "diff", "--name-only", base))


def staged_files(root: str) -> list[str]:
    return lines(_git(root, "diff", "--cached", "--name-only"))
