import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphonic.llm import packing, token_files
from graphonic.llm.tokens import Encoder, encoder

from .data import docs, empty

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def plain(name, text):
    return np.array([*encoder(name).model.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aB'sİΣéß1.,!? \n\t\x1c ́<|endotxrsa>", max_size=25), max_size=6))
def test_cut_texts_encode_as_whole_texts(name, texts):
    assert encoder(name).encode(texts) == [plain(name, t) for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr("graphonic.llm.tokens.REMEMBERED", 3)
    own = Encoder(NAMES[0])
    for text in ("the cat, the dog.", "the bird\nthe cat", "<|endoftext|> end", ""):
        assert own.encode([text, None]) == [plain(NAMES[0], text), plain(NAMES[0], "")]


@pytest.mark.parametrize("open_windows", [1, 16])
def test_packing_loses_nothing(spark, open_windows):
    df = docs(spark).repartition(3)
    got = packing.pack(df, open_windows=open_windows, length=128, merge_rows=5).collect()
    ids = {r.doc_id: plain(NAMES[0], r.text) for r in df.collect()}
    copies = collections.Counter(r.doc_id for r in df.collect())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) // 4 and r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    for doc, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == copies[doc] * len(ids[doc]) // 4
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 128
    assert set(by_doc) == set(ids)
    total = sum(n for p in by_doc.values() for _, n in p)
    assert len(by_sequence) <= 1.25 * total / 128 + 3


def test_packing_an_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0


def test_files_round_trip(spark, tmp_path):
    df = docs(spark)
    files = token_files.write_files(df, f"file://{tmp_path}/out", length=64)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_files(files, f"file://{tmp_path}/out").collect())
    want, at = [], 0
    for r in sorted(df.collect(), key=lambda r: r.doc_id):
        ids = plain(NAMES[1], r.text)
        want.append((at, r.doc_id, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    stream = b"".join(plain(NAMES[1], r.text) for r in sorted(df.collect(), key=lambda r: r.doc_id))
    seen = b""
    for name in sorted(r.name for r in files.collect()):
        k = 0
        while True:
            try:
                ids, mask = token_files.sequence(f"file://{tmp_path}/out", name, k)
            except (IndexError, ValueError, __import__("pyarrow").lib.ArrowInvalid):
                break
            assert len(ids) == len(mask) == 64
            seen += ids[mask].astype("<u4").tobytes()
            k += 1
    assert seen == stream


def test_files_of_an_empty_table(spark, tmp_path):
    files = token_files.write_files(empty(spark), f"file://{tmp_path}/none")
    assert token_files.read_files(files, f"file://{tmp_path}/none").count() == 0
