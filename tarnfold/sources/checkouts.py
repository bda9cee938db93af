"""Checked-out repositories below a folder, one for each commit. They live on the driver; load_tree reads them as a table."""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

from ..functions.text import checked_ref, repo_of, slug_of


def checkout_slug(url: str, sha: str) -> str:
    """owner__name@ and the first 12 digits of the commit."""
    owner, name = repo_of(url)
    return f"{slug_of(owner)}__{slug_of(name)}@{sha[:12]}"


def run_git(*args: str) -> str:
    done = subprocess.run(["git", *args], capture_output=True, text=True, check=False)  # noqa: S603, S607
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.strip()}")
    return done.stdout.strip()


def fetch(url: str, root: str, ref: str | None = None, git=run_git) -> Path:
    """The checkout of a repository at a ref (default: its head), made unless it is there; never seen half made."""
    repo_of(url)
    base = Path(root)
    base.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(prefix=".fetch-", dir=base) as room:
        work = Path(room) / "tree"
        wanted = ["--branch", checked_ref(ref)] if ref else []
        git("clone", "--depth", "1", *wanted, "--", url, str(work))
        target = base / checkout_slug(url, git("-C", str(work), "rev-parse", "HEAD"))
        if not target.exists():
            work.rename(target)
    return target


def checkouts(root: str, url: str | None = None) -> list[Path]:
    """All checkouts, or those of one repository, by name."""
    head = checkout_slug(url, "") if url else ""
    base = Path(root)
    return sorted(p for p in base.iterdir() if p.is_dir() and "@" in p.name and p.name.startswith(head)) if base.is_dir() else []


def newest(root: str, url: str | None = None) -> Path:
    """The checkout made last."""
    found = checkouts(root, url)
    if not found:
        raise FileNotFoundError(f"no checkout below {root}")
    return max(found, key=lambda p: (p.stat().st_mtime, p.name))
