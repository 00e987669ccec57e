import random
import zlib

import numpy as np
import pytest
from plain import DOCS, odd_rows

from surveyloom.llm import packing
from surveyloom.llm.queries import tokenizer_path


@pytest.mark.parametrize("seed", range(6))
def test_windows_use_up_all_lengths(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
    windows = packing.plan_windows(counts, 64)
    used = {}
    for times, chosen in windows:
        assert sum(n * k for n, k in chosen.items()) <= 64
        for n, k in chosen.items():
            used[n] = used.get(n, 0) + times * k
    assert used == counts


def test_first_window_has_the_least_slack():
    counts = {9: 1, 7: 2, 5: 3, 4: 1}
    _, chosen = packing.plan_windows(counts, 24)[0]
    assert sum(n * k for n, k in chosen.items()) == 24 and chosen[9] == 1
    assert packing.plan_windows({}, 24) == []


def check(rows, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for t in texts]
    spare = {}
    for doc in ids:
        spare.setdefault(len(doc), []).append(doc)
    pieces = sorted((r.doc_tokens, r.length, r.ids_crc32) for r in rows)
    want = sorted((len(d), len(d[s:s + capacity]), zlib.crc32(d[s:s + capacity].tobytes()))
                  for d in ids for s in range(0, len(d), capacity))
    assert pieces == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences) * capacity - sum(len(d) for d in ids)


def test_pieces_hold_the_tokenizer_ids(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert check(packing.pack(docs, tokenizer_path()).collect(), texts, 4096) < 4096


def test_odd_texts_and_rows(spark):
    odd = ["<|endoftext|> x<|startoftext|>y", "don't WE'LL 'S ''s 'tis", "é İ ΣΑΣ ß  x y", "a\x1cb\x85c",
           "1234 12a ½ ②", "\x00 \x01", "日本語 テスト", "!!!??? ...a...", "ÀÉ×÷ñ"]
    rows = odd_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as row", "2 as length", "3 as block", "4 as rank")
    check(packing.pack(docs, tokenizer_path(), capacity=32).collect(), [r[1] for r in rows], 32)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_workers_forget_and_learn_again(monkeypatch):
    import pyarrow as pa

    known = packing.WordIds(tokenizer_path())
    first = known.texts(pa.array(["some words here", ""]))
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 2)
    again = known.texts(pa.array(["other words there now", "some words here"]))
    assert again[0][again[1][0]:].tolist() == first[0].tolist()
