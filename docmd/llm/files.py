"""Files in the shared folder, written and read by workers."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def put(path: str, parts: list) -> None:
    """Writes a file under a name of its own and moves it into place, so that a repeated task changes nothing."""
    store, at = place(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    own = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        for part in parts:
            f.write(part)
    store.move(own, at)
