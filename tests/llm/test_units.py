"""Units of a text, as the two tokenizers of an alignment learn them."""

import numpy as np

from lectern.llm import alignment


def test_units_are_learnt_once_and_known_ones_left_alone(monkeypatch):
    pair = alignment.TokenPair(*(alignment.tokenizer_file(n) for n in (alignment.BYTE_BPE, alignment.PIECE_BPE)), cache_units=12)
    asked = []
    for side in (pair.a, pair.b):
        learn = side._learn
        monkeypatch.setattr(side, "_learn", lambda units, *rest, learn=learn: (asked.append((units, *rest)), learn(units, *rest)))
    texts = ["one two two three two", "two three one", "one  two\n three", "a ▁b a", "x\x00y � z", *(f"w{i} w{i + 1} one w{i}" for i in range(30))]
    for text in texts:
        a, b = pair.encode(text)
        want = pair.a.tokens.ids(text), pair.b.tokens.ids(text)
        spelled = [b"".join(side.tokens.spelled[i] for i in ids) == b" " + text.encode() for side, ids in zip((pair.a, pair.b), want, strict=True)]
        found = [np.frombuffer(raw, np.uint32).tolist() for raw in (a, b)]
        assert found == ([list(ids) for ids in want] if all(spelled) else [[], []]), text
    # Each call names the distinct units of a text, and which of them are new.
    assert asked and all(isinstance(units, set) and new for units, new, _ in asked)
