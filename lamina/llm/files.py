"""Binary files in the shared folder, written by tasks: whole or not at all.

A task writes under a name of its own attempt and then renames. The contents depend on the rows
alone, so a repeated or speculative attempt replaces a file with an equal one.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def publish(uri: str):
    """A binary output stream whose file appears at ``uri`` only if the block ends well."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(draft) as out:
            yield out
    except BaseException:
        store.delete_file(draft)
        raise
    store.move(draft, path)


@contextmanager
def opened(uri: str):
    """A seekable input file."""
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        yield f
