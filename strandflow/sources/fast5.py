"""HDF5 run files as a Spark data source: ``spark.dataSource.register(Fast5)``, then ``spark.read.format("fast5").load(path)``.

Each file is one partition, read where its task runs, so paths must be visible to executors. ``h5py`` is needed there
only; without it a read fails with its name. A path is a file, a folder (``recursive`` option) or a text list of files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_id string, channel int, number long, start_sample long, signal array<float>"


def expand(path: str, recursive: bool = False) -> list[str]:
    """The run files of a path; ``#`` lines of a list are skipped."""
    if os.path.isdir(path):
        folders = os.walk(path) if recursive else [(path, [], os.listdir(path))]
        return sorted(os.path.join(folder, f) for folder, _, names in folders for f in names if f.endswith(".fast5"))
    if path.endswith(".fast5"):
        return [path]
    with open(path) as f:
        return [x for line in f if (x := line.strip()) and not x.startswith("#")]


def groups(root: Mapping) -> Iterator[tuple[Mapping, Mapping]]:
    """(raw group, channel group) of each read. A file of one read has ``Raw`` at its root; otherwise each root group is a read."""
    if "Raw" in root:
        for read in root["Raw"]["Reads"].values():
            yield read, root["UniqueGlobalKey"]["channel_id"]
    else:
        for read in root.values():
            if "Raw" in read and "channel_id" in read:
                yield read["Raw"], read["channel_id"]


def decode(raw: Mapping, channel: Mapping, most: int | None = None) -> tuple:
    """One read, calibrated; integers are signed. ``most`` cuts the signal to so many samples."""
    text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
    attr = lambda g, name, default: g.attrs[name] if name in g.attrs else default
    span, digits, offset = (float(attr(channel, n, d)) for n, d in (("range", 1), ("digitisation", 1), ("offset", 0)))
    signal = (np.asarray(raw["Signal"][:most], dtype=np.float32) + offset) * span / digits
    return text(attr(raw, "read_id", "")), int(attr(channel, "channel_number", 0)), int(attr(raw, "read_number", 0)), int(attr(raw, "start_time", 0)), [float(x) for x in signal]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.recursive = options["path"], options.get("recursive", "false") == "true"
        self.most = int(options["samples"]) if "samples" in options else None

    def partitions(self):
        return [InputPartition(f) for f in expand(self.path, self.recursive)]

    def read(self, partition):
        import h5py

        with h5py.File(partition.value, "r") as root:
            for raw, channel in groups(root):
                yield decode(raw, channel, self.most)


class Fast5(DataSource):
    @classmethod
    def name(cls):
        return "fast5"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
