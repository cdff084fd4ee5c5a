"""An index that grows with a stream: every micro-batch becomes segments and a new commit point."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..sources import segments as S
from ..sources.segwrite import Field, write_commit, write_segments

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n: int) -> str:
    """A generation's name."""
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = _DIGITS[d] + out
    return out or "0"


def _newest(system: fs.FileSystem, root: str) -> dict:
    """The newest commit point, or what stands for one where there is none."""
    if system.get_file_info(root).type == fs.FileType.Directory:
        try:
            return S.commit(system, root, S.latest(system, root))
        except FileNotFoundError:
            pass
    return {"generation": "0", "segments": [], "user_data": {}}


def stream_id(checkpoint: str) -> str:
    """The id that Spark gave the stream of this checkpoint; a new checkpoint is another stream."""
    system, root = S.open_path(checkpoint)
    with system.open_input_file(f"{root}/metadata") as f:
        return json.loads(f.read())["id"]


def index_stream(stream: DataFrame, path: str, fields: list[Field], checkpoint: str, compound: bool = False) -> DataStreamWriter:
    """A writer that adds the rows of ``stream`` to the index at ``path``, which may exist; ``start()`` it. Readers see
    a batch when its commit point is there, which names the segments of the newest commit point before it and
    the new ones. Every commit point says which batch of which stream came last, so that a batch that runs again
    after a failure adds nothing, and the batches of a new stream, or of several by turns, are added; segments of
    one that failed before are never named. At any time one writer may commit. An empty batch adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        system, root = S.open_path(path)
        mark = "stream-" + stream_id(checkpoint)
        newest = _newest(system, root)
        if int(newest["user_data"].get(mark, -1)) >= number:
            return
        own = write_segments(batch, path, fields, compound)
        if own:
            names = [s["seg_name"] for s in newest["segments"]] + own
            write_commit(path, names, base36(int(newest["generation"], 36) + 1), newest["user_data"] | {mark: str(number)})

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
