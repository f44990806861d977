"""Bytes behind an address, with retries: what the paged source and the file fetcher read with, on executors and driver alike."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from pyarrow import fs

T = TypeVar("T")
TIMEOUT = 60


class Refused(Exception):
    """The service's answer says that asking again won't help."""


class Missing(Refused):
    """There is nothing at the address."""


def retried(work: Callable[[], T], retries: int = 3, backoff: float = 1.0) -> T:
    """``work()``, again after any error but ``Refused``, at most ``retries`` times; waits double, with up to half of each by chance so that tasks don't ask in step."""
    for k in range(retries + 1):
        try:
            return work()
        except Refused:
            raise
        except Exception:
            if k == retries:
                raise
            time.sleep(backoff * 2**k * (1 + random.random() / 2))
    raise AssertionError


def place(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address with or without a scheme; an empty host and one slash are both taken."""
    parts = urlsplit(address)
    if parts.scheme == "file":
        address = f"file://{parts.path}"
    return fs.FileSystem.from_uri(address)


def _landed(address: str) -> bytes:
    """A file, or the data files of a folder one after the other by name."""
    system, path = place(address)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise Missing(address)
    paths = [path]
    if info.type == fs.FileType.Directory:
        paths = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._")
        if not paths:
            raise Missing(f"no data file in {address}")
    out = []
    for p in paths:
        with system.open_input_stream(p) as f:
            out.append(f.read())
    return b"".join(out)


def read(address: str, headers: dict[str, str] | None = None) -> bytes:
    """The whole answer; http(s) by request, anything else as landed files. A request that the service calls wrong raises ``Refused``."""
    if urlsplit(address).scheme not in ("http", "https"):
        return _landed(address)
    try:
        with urlopen(Request(address, headers=headers or {}), timeout=TIMEOUT) as answer:
            return answer.read()
    except HTTPError as e:
        if 400 <= e.code < 500 and e.code not in (408, 425, 429):
            raise (Missing if e.code in (404, 410) else Refused)(f"{e.code} for {address}") from e
        raise
