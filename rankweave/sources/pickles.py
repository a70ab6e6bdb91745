"""Pair scores from pickles of {qid: {pid: score}}, read without running anything that a pickle says.

The reader knows the operations for numbers, strings and dictionaries, and
refuses every other, so nothing is imported, called or built. A pickle cannot
be split: a file is one row of one task.
"""

from __future__ import annotations

import gzip
import pickletools
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Operations whose argument is pushed as it is.
PUSHES = ("INT", "BININT", "BININT1", "BININT2", "LONG", "LONG1", "LONG4", "FLOAT", "BINFLOAT", "UNICODE", "SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8")
NOTHING = ("PROTO", "FRAME")
MARK = object()


class Refused(ValueError):
    """The pickle holds an operation that scores have no use for."""


def loaded(data: bytes) -> Any:
    """What a pickle of numbers, strings and dictionaries holds; Refused for any other."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    stack: list[Any] = []
    memo: dict[int, Any] = {}
    for op, value, place in pickletools.genops(data):
        name = op.name
        if name in NOTHING:
            continue
        if name in PUSHES:
            stack.append(value)
        elif name == "NONE":
            stack.append(None)
        elif name == "EMPTY_DICT":
            stack.append({})
        elif name == "MARK":
            stack.append(MARK)
        elif name in ("DICT", "SETITEMS"):
            at = max(i for i, x in enumerate(stack) if x is MARK)
            items, stack[at:] = stack[at + 1 :], []
            if name == "DICT":
                stack.append({})
            _into(stack[-1], items, place)
        elif name == "SETITEM":
            items, stack[-2:] = stack[-2:], []
            _into(stack[-1], items, place)
        elif name == "MEMOIZE":
            memo[len(memo)] = stack[-1]
        elif name in ("PUT", "BINPUT", "LONG_BINPUT"):
            memo[int(value)] = stack[-1]
        elif name in ("GET", "BINGET", "LONG_BINGET"):
            stack.append(memo[int(value)])
        elif name == "STOP":
            return stack.pop()
        else:
            raise Refused(f"{name} at byte {place}")
    raise Refused("no end")


def _into(target: Any, items: list, place: int) -> None:
    if not isinstance(target, dict) or len(items) % 2 or any(isinstance(key, dict) or key is MARK for key in items[::2]):
        raise Refused(f"no entries of a dictionary at byte {place}")
    target.update(zip(items[::2], items[1::2], strict=True))


def pair_scores(data: bytes) -> tuple[list[str], list[str], list[float]]:
    """(qids, pids, scores) as columns; ids as text."""
    held = loaded(data)
    if not isinstance(held, dict) or any(not isinstance(own, dict) for own in held.values()):
        raise Refused("not a dictionary of dictionaries")
    rows = [(str(qid), str(pid), float(score)) for qid, own in held.items() for pid, score in own.items()]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def ce_pickles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(qid, pid, ce) of pickled scores, gzip-compressed or not; a file with anything else ends the query with Refused."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(pair_scores(data.as_py()), (pa.string(), pa.string(), pa.float64()), strict=True)], ["qid", "pid", "ce"])

    return files.mapInArrow(run, "qid string, pid string, ce double")
