"""The commit hook of a repository: scans what is staged and stops a commit with findings."""

from __future__ import annotations

import os

#: What tells our hook from another's.
_SIGN = "# gleanguard staged scan"
_HOOK = f"""#!/bin/sh
{_SIGN}
command -v python3 > /dev/null || exit 0
cd "$(git rev-parse --show-toplevel)" || exit 0
python3 -m gleanguard --staged --fail-on medium . && exit 0
echo "gleanguard: staged files hold findings; git commit --no-verify goes past this check" >&2
exit 1
"""


def _path(root: str) -> str:
    folder = os.path.join(root, ".git", "hooks")
    if not os.path.isdir(os.path.dirname(folder)):
        raise FileNotFoundError(f"no repository in {root}")
    return os.path.join(folder, "pre-commit")


def install(root: str) -> str:
    """Writes the hook; another tool's hook is kept and named in an error."""
    path = _path(root)
    if os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            if _SIGN not in f.read():
                raise FileExistsError(f"{path} is another hook")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(_HOOK)
    os.chmod(path, 0o755)
    return f"installed {path}"


def uninstall(root: str) -> str:
    """Removes the hook if it is ours."""
    path = _path(root)
    if not os.path.exists(path):
        return "no hook is installed"
    with open(path, encoding="utf-8", errors="replace") as f:
        if _SIGN not in f.read():
            raise FileExistsError(f"{path} is another hook")
    os.remove(path)
    return f"removed {path}"
