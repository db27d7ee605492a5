"""What Python workers hold, as they stay when their tasks have ended."""

import tracemalloc

import public_tokenizers
import pyarrow as pa

from corpusgrid.llm import common, near_dedup, tokens


def test_slices_of_texts_are_small():
    texts = pa.array([" ".join(f"word{i}-{k}" for k in range(200)) for i in range(1000)])
    a, b = next(tokens.slices(texts, near_dedup.TEXT_BYTES))
    near_dedup.shingles(texts.slice(a, b - a))  # the powers of the hashes are kept
    tracemalloc.start()
    near_dedup.shingles(texts.slice(a, b - a))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b > 1 and peak < 40 << 20


def test_encoder_rests():
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [x.tolist() for x in encoder.encode(pa.array(["some words", "more words"]))]
    encoder.rest()
    assert encoder.kept
    encoder.kept |= {f" w{i}": b"" for i in range(tokens.RESTING)}
    encoder.rest()
    assert not encoder.kept and [x.tolist() for x in encoder.encode(pa.array(["some words", "more words"]))] == ids


def test_released(monkeypatch):
    calls = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(1)})())
    got = common.released(iter([1, 2]))
    assert next(got) == 1 and not calls
    assert list(got) == [2] and calls == [1]
