"""What Python workers keep from task to task."""

from __future__ import annotations

import importlib.util
import json
import subprocess
import sys
from types import SimpleNamespace

import pyarrow as pa
import pytest

from stepforge.llm import common
from stepforge.llm.registry import tokenizer


def test_kept_while_tasks_ask_for_it(monkeypatch):
    """A worker keeps a value for tasks that ask for it, and forgets it when a task of another operator begins."""
    task, made = [1], []
    monkeypatch.setattr(common, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(taskAttemptId=lambda: task[0])))
    monkeypatch.setattr(common, "_remembered", {})
    batch = pa.RecordBatch.from_arrays([pa.array(["a"])], names=["text"])

    def run(number: int, asks: bool) -> object:
        task[0] = number
        value = common.remembered("key", lambda: made.append(number) or object()) if asks else None
        assert list(common.text_slices(iter([batch]))) == [batch]
        return value

    assert run(1, True) is run(2, True) and made == [1]
    run(3, False)
    assert not common._remembered
    run(4, True)
    assert made == [1, 4]


WORKER = """
import json, random, sys
from types import SimpleNamespace
import pyarrow as pa
from stepforge.llm import packing

def anonymous(what):
    return int(open("/proc/self/status").read().split(what)[1].split()[0]) >> 10

path, settings = sys.argv[1], json.loads(sys.argv[2])
packing.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
packing.loaded(path, words=True, most=settings["remembered"])
before, draw = anonymous("RssAnon:"), random.Random(1)
words = ("".join(draw.choices("abcdefghijklmnop", k=9)) for _ in range(360_000))
texts = [" ".join(next(words) for _ in range(120)) for _ in range(3_000)]
batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(texts[i : i + 100])], names=["doc_id", "text"]) for i in range(0, 3_000, 100)]
held = anonymous("RssAnon:") - before
cut = packing._pieces(path, packing.CAPACITY, packing.END_ID, **settings)
most = max(anonymous("RssAnon:") for _ in cut(iter(batches)))
print(most - before - held)
"""


def test_a_packing_worker_of_the_pipeline_stays_small(monkeypatch):
    """360,000 words that differ cost a worker of the pipeline's last stage below 100 MB beside the tokenizer."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline here")
    import corpus_pipeline

    asked = {}
    monkeypatch.setattr(corpus_pipeline, "packed_documents", lambda docs, path, **settings: asked.update(settings))
    corpus_pipeline.packing_stage(None, None, "")
    out = subprocess.run([sys.executable, "-c", WORKER, tokenizer("word_bpe_49k.json"), json.dumps(asked)], capture_output=True, text=True, timeout=300, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 100
