"""Hooks that sync an index after git moved files, and whether an index belongs to another work tree."""

from __future__ import annotations

import subprocess
from pathlib import Path
from typing import NamedTuple

#: git's names of the hooks after which files may differ.
HOOKS = ("post-commit", "post-merge", "post-checkout")
BEGIN, END = "# >>> tessera sync >>>", "# <<< tessera sync <<<"
BLOCK = "\n".join([BEGIN, "# brings the index up to date in the background; delete this block to stop that", "if command -v tessera >/dev/null 2>&1; then", "  ( tessera sync -q >/dev/null 2>&1 & ) >/dev/null 2>&1", "fi", END])


def _git(root: str | Path, *words: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", str(root), *words], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def is_repository(root: str | Path) -> bool:
    return _git(root, "rev-parse", "--is-inside-work-tree") == "true"


def hooks_folder(root: str | Path) -> Path | None:
    """Where git looks for root's hooks, also with a folder of one's own or in a linked work tree."""
    at = _git(root, "rev-parse", "--git-path", "hooks")
    return (Path(root) / at).resolve() if at else None


def without_block(text: str) -> str:
    out, inside = [], False
    for line in text.split("\n"):
        if line.strip() in (BEGIN, END):
            inside = line.strip() == BEGIN
        elif not inside:
            out.append(line)
    return "\n".join(out)


def install(root: str | Path, hooks: tuple[str, ...] = HOOKS) -> list[str]:
    """Put the block into hooks, beside what they hold; the hooks that have it now, none outside a repository. Once or often is the same."""
    folder = hooks_folder(root)
    if folder is None:
        return []
    folder.mkdir(parents=True, exist_ok=True)
    for hook in hooks:
        at = folder / hook
        own = without_block(at.read_text()).rstrip() if at.exists() else ""
        at.write_text(f"{own}\n\n{BLOCK}\n" if own else f"#!/bin/sh\n{BLOCK}\n")
        at.chmod(0o755)
    return list(hooks)


def remove(root: str | Path, hooks: tuple[str, ...] = HOOKS) -> list[str]:
    """Take the block out of hooks; a hook with nothing else goes. The hooks that had it."""
    folder, had = hooks_folder(root), []
    for hook in hooks if folder else ():
        at = folder / hook
        if not at.exists() or BEGIN not in at.read_text():
            continue
        own = without_block(at.read_text()).rstrip()
        if all(not line.strip() or line.startswith("#!") for line in own.split("\n")):
            at.unlink()
        else:
            at.write_text(own + "\n")
        had.append(hook)
    return had


def installed(root: str | Path, hooks: tuple[str, ...] = HOOKS) -> bool:
    folder = hooks_folder(root)
    return folder is not None and any((folder / h).exists() and BEGIN in (folder / h).read_text() for h in hooks)


class Mismatch(NamedTuple):
    """The work tree that one is in, and the one whose index is used."""

    here: str
    index: str

    def __str__(self) -> str:
        return f"the index belongs to another work tree ({self.index}) than this one ({self.here}); it may show another branch. Make one here by: tessera init"


def mismatch(start: str | Path, index_root: str | Path) -> Mismatch | None:
    """Set if start lies in a work tree and index_root is the root of another."""
    here = _git(start, "rev-parse", "--show-toplevel")
    index = Path(index_root).resolve()
    if here is None or Path(here).resolve() == index:
        return None
    other = _git(index, "rev-parse", "--show-toplevel")
    return Mismatch(str(Path(here).resolve()), str(index)) if other and Path(other).resolve() == index else None
