import base64
import os
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from locusflow.llm import sentencepiece as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    with open(sp.MODEL, "rb") as f:
        return sp.Model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def samples(texts):
    rng = random.Random(9)
    out = [t or "" for t in texts if len(t or "") < 20_000]
    out += ["".join(rng.choice("abcdefgh ▁'.,\n1234éñ日😀") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return out + ["ab" * 300, "    four  spaces ", "<s> </s> <0x0A>", "IIIIIIII", "．．．"]


def test_ids_equal_the_library(model, library, texts):
    encoder = sp.Encoder(model)
    own = samples(texts)
    for text, ids in zip(own, encoder.encode(own), strict=True):
        assert ids.tolist() == library.encode(text), text


def test_long_units_advance_in_windows(model, library):
    """Text without white space: random, of other scripts, and repetitive, where windows never agree."""
    rng = random.Random(12)
    encoder = sp.Encoder(model)
    own = [
        "".join(chr(rng.choice([rng.randrange(0x4E00, 0x5200), rng.randrange(0x3041, 0x3090), 0x3002])) for _ in range(30_000)),
        base64.b64encode(rng.randbytes(20_000)).decode(),
        "".join(rng.choice(["the", "international", "tokenization", "xyz", "ing"]) for _ in range(4000)),
        "A" * 20_000, "abc" * 5000, "=-" * 3000 + "=", "é" * 5000, "a b " * 900 + "q" * 2049 + " end", *("x" * n + "yz" for n in (2046, 2047, 2048, 2557, 2558, 3070, 3071, 3072)),
    ]
    for text, ids in zip(own, encoder.encode(own), strict=True):
        assert ids.tolist() == library.encode(text), text[:40]
    assert not any(len(u) > sp.LONG for u in encoder.cache)


def test_decoding_equals_the_library_and_round_trips(model, library, texts):
    decoder, encoder = sp.Decoder(model), sp.Encoder(model)
    for text in samples(texts):
        ids = encoder.encode([text])[0].tolist()
        assert decoder.decode(ids) == library.decode(ids)
        if sp.SPACE not in text:
            assert decoder.decode(ids) == text


def _message(fields):
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v for k, v in fields)


def test_unigram_paths_equal_the_library():
    """A small unigram model, written by hand, against the library's own Viterbi."""
    import struct

    def piece(text, score, kind=1):
        own = _message([(1, text.encode())]) + b"\x15" + struct.pack("<f", score) + (_message([(3, kind)]) if kind != 1 else b"")
        return 1, own

    rng = random.Random(4)
    words = ["▁", "a", "b", "c", "d", "▁a", "ab", "abc", "bc", "bcd", "cd", "da", "▁ab", "dab", "aa", "bb"]
    pieces = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3), *[piece(w, -rng.uniform(1, 9)) for w in words]]
    data = _message([*pieces, (2, _message([(3, 1), (4, len(pieces))])), (3, _message([(1, b"identity"), (3, 1), (4, 0), (5, 1)]))])
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = sp.Model(data)
    assert model.type == sp.UNIGRAM and not model.byte_fallback
    encoder = sp.Encoder(model)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["xyz", "axxb x"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text)
        # paths of equal score (a + aa, aa + a) may differ by the rounding of longer sums
        assert "".join(model.piece[i] for i in ids.tolist()) == "".join(model.piece[i] for i in want)
        assert sum(float(model.score[i]) for i in ids) == pytest.approx(sum(float(model.score[i]) for i in want), abs=1e-3), text


def test_caches_that_fill_up_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(sp, "CACHE_UNITS", 10)
    monkeypatch.setattr(sp, "CACHE_PAIRS", 8)
    encoder = sp.Encoder(model)
    for text in ["the nation was here", "the nations were there", "and unbelievable things", "the nation was here again"] * 2:
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_documents(docs, empty, library):
    clash = docs.withColumn("IDS", F.lit(1))
    got = sp.encode(clash, check=True).collect()
    by = {str(r.doc_id): r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.n_pieces == len(r.ids)
        if len(by[str(r.doc_id)] or "") < 20_000:
            assert r.ids == library.encode(by[str(r.doc_id)] or "")
        assert r.round_trip
    back = {str(r.doc_id): r.text for r in sp.decode(sp.encode(docs)).collect()}
    assert back == {k: v or "" for k, v in by.items()}
    assert sp.encode(empty).count() == 0 and sp.decode(sp.encode(empty)).count() == 0
