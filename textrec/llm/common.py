"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrec.session import shared_folder, stored

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where no character is longer than a byte."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/textrec/{label}-{uuid.uuid4().hex}"


def parts(spark: SparkSession) -> int:
    """Partitions for a shuffle that AQE cannot size, as its rows pass through Python."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, that returns its free memory to the system at its end.

    Python workers stay for the tasks and stages that follow, beside the
    executor's heap, with all that their allocators ever kept.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return whole


def ship_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Sends arrays to every executor, as files that its workers map into memory; returns their name.

    The driver's folder only holds them for Spark's own file distribution, which
    also serves executors that join later.
    """
    name, folder = f"arrays-{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="textrec-arrays-")
    for part, values in arrays.items():
        path = os.path.join(folder, f"{name}-{part}.npy")
        np.save(path, values)
        spark.sparkContext.addFile(path)
    return name


def load_array(name: str, part: str) -> np.ndarray:
    """One of the arrays on an executor, mapped and not read; an empty array cannot be mapped."""
    path = SparkFiles.get(f"{name}-{part}.npy")
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:
        return np.load(path)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the folder's name there."""
    local = re.sub(r"^file:/+", "/", path)
    return (pyarrow.fs.LocalFileSystem(), local) if local.startswith("/") else pyarrow.fs.FileSystem.from_uri(path)


def save_arrays(folder: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays to a new shared folder; for tasks, whose arrays the driver then never holds."""
    system, at = _place(folder)
    system.create_dir(at)
    for part, values in arrays.items():
        with system.open_output_stream(f"{at}/{part}.npy") as out:
            np.save(out, values)


def open_array(folder: str, part: str) -> np.ndarray:
    """One of the arrays in a shared folder, mapped; from a store that cannot be mapped an executor copies it once."""
    system, at = _place(folder)
    path = f"{at}/{part}.npy"
    if not isinstance(system, pyarrow.fs.LocalFileSystem):
        path, source = os.path.join(SparkFiles.getRootDirectory(), f"{os.path.basename(at)}-{part}.npy"), path
        if not os.path.exists(path):
            own = f"{path}-{uuid.uuid4().hex}"
            with system.open_input_stream(source) as data, open(own, "wb") as out:
                while block := data.read(1 << 20):
                    out.write(block)
            os.replace(own, path)
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array cannot be mapped
        return np.load(path)


__all__ = ["ASCII_UPPER", "ascii_lower", "giving_back", "load_array", "open_array", "parts", "read", "save_arrays", "scratch", "ship_arrays", "stored"]
