"""Files in shared storage, by URI, from tasks."""

from __future__ import annotations

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def open_to_write(uri: str):
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None, buffer_size=1 << 20)  # else a name in .gz is compressed once more


def open_to_read(uri: str):
    store, path = _at(uri)
    return store.open_input_file(path)
