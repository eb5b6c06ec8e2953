"""Histories and snapshots from a version-controlled folder; the commands run on the driver."""

from __future__ import annotations

import subprocess
import tarfile
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.schema import COMMITS

MARKER = "@@commit "


def git(folder: str, *args: str) -> str | None:
    """What git says, or None if it fails."""
    try:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=120, errors="replace")
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def parse_log(text: str) -> list[tuple[str, int, list[str]]]:
    """(sha, seq, files) of a log whose records begin with the marker; what comes before the first is left out."""
    out: list[tuple[str, int, list[str]]] = []
    for line in text.splitlines():
        if line.startswith(MARKER):
            out.append((line[len(MARKER) :].strip(), len(out), []))
        elif line.strip() and out:
            out[-1][2].append(line.strip())
    return out


def read_commits(spark: SparkSession, folder: str, max_commits: int = 500) -> DataFrame:
    """The newest commits, seq 0 first; a folder without history has none."""
    log = git(folder, "log", f"--max-count={max_commits}", "--no-merges", "--name-only", "--relative", f"--pretty=format:{MARKER}%H")
    return spark.createDataFrame(parse_log(log or ""), COMMITS)


def base_ref(folder: str, given: str | None = None) -> str | None:
    """The given one, or where the branch left the main one."""
    if given:
        return given
    for name in ("origin/HEAD", "origin/main", "origin/master", "main", "master"):
        if found := git(folder, "merge-base", "HEAD", name):
            return found.strip()
    return None


def materialize(folder: str, ref: str) -> str:
    """The files of a commit in a folder of their own; ``working`` is the folder itself."""
    if ref == "working":
        return folder
    out = tempfile.mkdtemp(prefix="weftgraph-ref-")
    archive = Path(out) / ".archive.tar"
    if git(folder, "archive", "--format=tar", "-o", str(archive), ref) is None:
        raise ValueError(f"no such commit: {ref}")
    with tarfile.open(archive) as tar:
        tar.extractall(out, filter="data")
    archive.unlink()
    return out


def rebase_globs(globs: list[str], cwd: str, top: str) -> list[str]:
    """Globs relative to the repository's top: those of the working folder get its path before them, unless they
    begin with it already."""
    prefix = Path(cwd).resolve().relative_to(Path(top).resolve()).as_posix()
    if prefix == ".":
        return list(globs)
    return [g if g == prefix or g.startswith(prefix + "/") else f"{prefix}/{g}" for g in globs]
