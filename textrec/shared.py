"""Files outside Spark's readers: arrays in the shared folder, written by tasks and mapped by the workers that read them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow.fs


def file_place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    local = re.sub(r"^file:/+", "/", path)
    return (pyarrow.fs.LocalFileSystem(), local) if local.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays to a new folder."""
    system, at = file_place(folder)
    system.create_dir(at)
    for name, values in arrays.items():
        with system.open_output_stream(f"{at}/{name}.npy") as out:
            np.save(out, values)


def open_arrays(folder: str, names: list[str]) -> dict[str, np.ndarray]:
    """Arrays of a folder, mapped; those of a store that cannot be mapped are fetched into a file without a name first."""
    system, at = file_place(folder)
    return {name: _opened(system, f"{at}/{name}.npy") for name in names}


def _opened(system: pyarrow.fs.FileSystem, path: str) -> np.ndarray:
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        return _mapped(path)
    own = os.path.join(tempfile.gettempdir(), f"{uuid.uuid4().hex}.npy")
    try:
        with system.open_input_stream(path) as data, open(own, "wb") as out:
            while block := data.read(1 << 20):
                out.write(block)
        return _mapped(own)  # stays readable when its name is gone
    finally:
        os.unlink(own)


def _mapped(path: str) -> np.ndarray:
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array cannot be mapped
        return np.load(path)
