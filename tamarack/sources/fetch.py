"""Driver-side helpers around files: retries, freshness, retention, source policies."""

from __future__ import annotations

import os
import shutil
import time
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from ..errors import ManifestError


def with_retries(work: Callable[[bool], object], attempts: int = 3, seconds: float = 600.0, pause: float = 1.0):
    """The result of ``work(force)``, tried again after an error or when it takes too long; later tries force a fresh copy."""
    last: BaseException | None = None
    for number in range(attempts):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(work, number > 0).result(timeout=seconds)
        except Exception as e:  # noqa: BLE001 - reported after the last try
            last = e
            time.sleep(pause * number)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    raise ManifestError(f"failed after {attempts} attempts: {last}") from last


def download(url: str, target: str | os.PathLike, attempts: int = 3, seconds: float = 60.0, pause: float = 1.0) -> Path:
    """The file at ``url`` as ``target``, which stands only when complete; one that stands already is kept.

    A try that breaks off goes on where it stopped if the source allows it; ``seconds`` bounds each wait for data, so a source that
    hangs ends the try itself and leaves no thread behind.
    """
    target = Path(target)
    if target.exists():
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.part")
    last: BaseException | None = None
    for number in range(attempts):
        try:
            have = part.stat().st_size if part.exists() else 0
            ask = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
            with urllib.request.urlopen(ask, timeout=seconds) as source, part.open("ab" if have and getattr(source, "status", None) == 206 else "wb") as out:
                wanted = source.headers.get("Content-Length")
                before = out.tell()
                shutil.copyfileobj(source, out, 1 << 20)
                if wanted is not None and out.tell() - before < int(wanted):
                    raise OSError(f"{out.tell() - before} of {wanted} bytes")
            os.replace(part, target)
            return target
        except OSError as e:
            last = e
            time.sleep(pause * number)
    raise ManifestError(f"{url}: {last}") from last


def fresh(result: str | os.PathLike, *inputs: str | os.PathLike) -> bool:
    """Whether a result exists and is not older than any of its inputs."""
    made = Path(result)
    return made.exists() and all(Path(p).stat().st_mtime <= made.stat().st_mtime for p in inputs if Path(p).exists())


def prune(folder: str | os.PathLike, keep: set[str]) -> list[str]:
    """Delete the subfolders of a checkpoint folder but those to keep; returns the deleted names."""
    gone = sorted(p.name for p in Path(folder).iterdir() if p.is_dir() and p.name not in keep)
    for name in gone:
        shutil.rmtree(Path(folder) / name)
    return gone


def require_policy(allowed: dict[str, tuple[str, ...]], configured: dict[str, list[str]]) -> None:
    """Each source may give exactly the languages of the policy, in its order."""
    for source in sorted({*allowed, *configured}):
        if tuple(configured.get(source, ())) != tuple(allowed.get(source, ())):
            raise ManifestError(f"source {source} must give exactly {list(allowed.get(source, ()))}")
