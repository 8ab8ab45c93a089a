import re
from pathlib import Path

import pyarrow as pa

from tessera.llm import common

_pins = []


def _resident():
    """MB of this process, without mapped files."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def _takes_much(batches):
    for batch in batches:
        held = [bytes(2000) for _ in range(100_000)]
        _pins.append(bytes(2000))  # what stays lies above what goes
        yield batch.slice(0, len(held))


def test_a_task_gives_back_what_it_has_freed():
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    before = _resident()
    assert [b.num_rows for b in _takes_much(iter([batch]))] == [2]
    kept = _resident() - before
    assert [b.num_rows for b in common.gives_back(_takes_much)(iter([batch] * 2))] == [2, 2]
    assert kept > 150 and _resident() - before < 50


def test_a_task_that_fails_or_is_left_gives_back_too():
    before = _resident()
    task = common.gives_back(_takes_much)(iter([pa.RecordBatch.from_pydict({"x": [1]})] * 2))
    next(task)
    assert _resident() - before > 150
    task.close()
    assert _resident() - before < 50
