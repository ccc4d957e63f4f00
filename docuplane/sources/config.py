"""Settings, environment files and run manifests, read on the driver."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import subprocess
import tomllib
from pathlib import Path


def load_config(name_or_path: str, directory: str | Path = "configs") -> dict:
    """A TOML file, by path or by its bare name in ``directory``, with a hash of its content."""
    path = Path(name_or_path)
    if path.suffix != ".toml":
        path = Path(directory) / f"{name_or_path}.toml"
    raw = path.read_bytes()
    return tomllib.loads(raw.decode("utf-8")) | {"_hash": hashlib.sha256(raw).hexdigest()}


def parse_env(text: str) -> dict[str, str]:
    """``NAME=value`` lines; comments and lines without a name are passed over, quotes taken off."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        name, value = name.strip(), value.strip()
        if not eq or not name or name.startswith("#"):
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[name] = value
    return out


def load_env(path: str | Path, environ: dict | None = None) -> dict[str, str]:
    """Set what the file names and is not set yet; a missing file sets nothing."""
    target = os.environ if environ is None else environ
    found = parse_env(Path(path).read_text("utf-8")) if Path(path).exists() else {}
    for k, v in found.items():
        if v and k not in target:
            target[k] = v
    return found


def require_env(name: str, environ: dict | None = None) -> str:
    value = (os.environ if environ is None else environ).get(name, "")
    if not value:
        raise KeyError(f"{name} is not set")
    return value


def manifest(paths: list[str | Path], config: dict | None = None) -> dict:
    """Hashes and sizes of files (or that they are missing), the revision, and the settings' hash."""
    files = []
    for p in map(Path, paths):
        files.append({"path": str(p), "missing": True} if not p.exists() else {"path": str(p), "sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "bytes": p.stat().st_size})

    def git(*a: str) -> str:
        return subprocess.run(["git", *a], capture_output=True, text=True).stdout.strip()

    whole = json.dumps(config or {}, sort_keys=True, default=str).encode()
    return {"files": files, "revision": git("rev-parse", "HEAD") or None, "dirty": bool(git("status", "--porcelain")), "config": hashlib.sha256(whole).hexdigest(), "made": dt.datetime.now(dt.UTC).isoformat()}
