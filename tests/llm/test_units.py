"""Parts of texts and their ids: each is encoded once, whatever marks follow it."""

import random

import pyarrow as pa

from mosslight.llm import token_store as T


def test_known_letters_are_not_encoded_again(monkeypatch):
    """Before, letters that the older half of the table holds were encoded again for each mark that follows them."""
    coder = T.UnitEncoder(T.tokenizer_path())
    first = coder.encode(pa.array(["alpha beta"]), 2)
    coder.limit, coder.held = 0, 1
    asked = []
    ids = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda texts: asked.extend(texts) or ids(texts))
    assert coder.encode(pa.array(["alpha, beta. alpha"]), 2) == T.WholeEncoder(T.tokenizer_path()).encode(pa.array(["alpha, beta. alpha"]), 2)
    assert "alpha" not in " ".join(asked) and "beta" not in " ".join(asked)
    assert first == T.WholeEncoder(T.tokenizer_path()).encode(pa.array(["alpha beta"]), 2)


def test_parts_of_all_kinds_have_the_ids_of_whole_texts():
    draw = random.Random(4)
    pool = [*map(chr, range(1, 0x180)), *"İıſKǺςΣ中٣", "abc", "It", "'s", "...", "<|", "<|endoftext|>"]
    texts = ["".join(draw.choices(pool, k=draw.randint(0, 6))) + draw.choice([" ", "\n", ""]) + draw.choice(pool) + draw.choice(["", ",", ".)", "?!"]) for _ in range(4000)]
    texts += [chr(i) + "a." for i in range(1, 0x250)]
    coder = T.UnitEncoder(T.tokenizer_path())
    coder.limit = 20_000
    got = [x for i in range(0, len(texts), 300) for x in coder.encode(pa.array(texts[i : i + 300]), 2)]
    assert got == T.WholeEncoder(T.tokenizer_path()).encode(pa.array(texts), 2)


def test_lists_of_strings():
    assert T.strings(pa.array(["a", "", "é\n"])) == ["a", "", "é\n"] and T.strings(pa.array([], pa.string())) == []
