"""The leaves of many texts at once, against the tree of each."""

import random

import pyarrow as pa

from mosslight.llm import token_counts as C
from mosslight.llm import token_store as T


def test_leaves_of_many_texts(monkeypatch):
    """Before, pre-tokens were looked up text by text."""
    draw = random.Random(9)
    pool = ["abc", "It's", "don't,", "", "", "a\nb", "\n", "\n\n", "x\n", "É́té", "İſK", "中文3", "<|endoftext|>", "<|x", "Q<|endoftext|>\nq", "\t", "r s", "12-34", "👍🏽", "...", "THE"]
    texts = [None, "", " ", "\n", "a", *(" ".join(draw.choices(pool, k=draw.randint(0, 120))) for _ in range(200)), None, " " * 40, "\n" * 40, "w " * 16, "w " * 15 + "w", None]
    count = C.counter(T.tokenizer_path())
    want = []
    for t in texts:
        own = None if t is None else C.TokenTree.build(t, count)
        want.append(None if own is None else {"chars": own.chars.tolist(), "tokens": own.tokens.tolist()})
    calls, known = [], T.UnitEncoder.known
    monkeypatch.setattr(T.UnitEncoder, "known", lambda self, units: calls.append(1) or known(self, units))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for a, b in ((0, len(texts)), (3, 20), (0, 1), (len(texts) - 1, len(texts)), (5, 5)):
        calls.clear()
        out = list(C._trees(T.tokenizer_path(), "text", "tree", ["doc_id"])([batch.slice(a, b - a)]))
        assert [r["tree"] for x in out for r in x.to_pylist()] == want[a:b]
        assert [r["doc_id"] for x in out for r in x.to_pylist()] == list(range(a, b))
        assert len(calls) <= 1
