"""Files that executors write next to each other in the shared folder, and that Spark reads back."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def place(folder: str, suffix: str) -> tuple[int, str]:
    """This task's number and the file it writes; task numbers follow the order of the partitions."""
    part = TaskContext.get().partitionId()
    return part, f"{folder}/part-{part:08d}{suffix}"


def publish(path: str, data: list[bytes]) -> int:
    """Writes a file whole or not at all, so a task that runs again replaces what a lost one left."""
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    hidden = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        for x in data:
            out.write(x)
    system.move(hidden, at)
    return sum(map(len, data))
