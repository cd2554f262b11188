"""Git branches of a checkout."""

from __future__ import annotations

import hashlib
import re
import subprocess


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def current_branch(root: str) -> str | None:
    """None outside a repository and on a detached head."""
    return _git(root, "symbolic-ref", "--short", "-q", "HEAD") or None


def list_branches(root: str) -> list[str]:
    return (_git(root, "for-each-ref", "--format=%(refname:short)", "refs/heads") or "").split()


def sanitize(branch: str) -> str:
    """The same name as the column function ``branch_name`` gives."""
    return re.sub(r"[^A-Za-z0-9._-]", "-", branch)[:60] + "-" + hashlib.sha1(branch.encode()).hexdigest()[:8]
