import random
import zlib
from collections import Counter, defaultdict

import corpus_cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridsight.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


ALPHABET = list(" \n\t  \r\x0bab'sé1²5!?.ß中 ​ǅ𝔸Ж\x85\x1c\x00") + ["<|endoftext|>", "'re", " 's", "  "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=8))
def test_ids_are_those_of_the_library(tokenizer, texts):
    encoder = tokens.encoder(packing.default_tokenizer())
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == [ids(tokenizer, t)[:-1] for t in texts]


def test_long_texts_are_cut_safely(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 20_000)
    encoder = tokens.Encoder(packing.default_tokenizer())
    texts = ["ab cd\n\n ef " * 9000, "x" * 50_000, "", "é 1" * 9000, "it's " * 9000]
    assert [x.tolist() for x in encoder.encode(texts)] == [ids(tokenizer, t)[:-1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60), st.lists(st.integers(1, 60), max_size=200))
def test_plan_holds_every_piece_once(capacity, lengths):
    counts = Counter(min(x, capacity) for x in lengths)
    plan = packing.plan(counts, capacity)
    held = Counter()
    for pattern, uses in plan:
        assert uses > 0 and sum(s * k for s, k in pattern) <= capacity
        assert sum(k for s, k in pattern if s > capacity // 3 and 3 * s > capacity) <= 2
        for s, k in pattern:
            held[s] += k * uses
    assert held == counts


def test_plan_is_best_fit_decreasing():
    """The same number of sequences as packing piece by piece."""
    pick = random.Random(1)
    for _ in range(40):
        capacity = 100
        lengths = [pick.randint(1, 33) for _ in range(pick.randint(1, 120))]
        gaps = []
        for s in sorted(lengths, reverse=True):
            fits = [g for g in gaps if g >= s]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - s)
            else:
                gaps.append(capacity - s)
        plan = packing.plan(Counter(lengths), capacity)
        assert sum(uses for _, uses in plan) == len(gaps)


def test_large_pieces_are_matched_as_often_as_can_be():
    # 60+40, 55+45, 50+50; the rest alone.
    plan = packing.plan({60: 1, 55: 1, 50: 3, 45: 1, 40: 1, 90: 1}, 100)
    assert sum(u for _, u in plan) == 5


@pytest.mark.parametrize("capacity,group_rows", [(1024, 2_000), (16, 5)])
def test_round_trip(spark, sf_dir, tokenizer, capacity, group_rows, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = corpus_cases.plain(spark, [(10_000, None), (10_001, ""), (10_002, "a" * 3000), (10_003, "same"),
                                       *((10_010 + i, "same words here") for i in range(60))])
    docs = docs.union(extra)
    packing.pieces(docs, capacity=capacity).write.parquet(str(tmp_path / "p"))
    rows = packing.pack(spark.read.parquet(str(tmp_path / "p")), capacity=capacity,
                        group_rows=group_rows).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(found) == set(texts)
    for doc_id, text in texts.items():
        whole = np.array(ids(tokenizer, text), "<u4")
        at = 0
        for k, r in enumerate(sorted(found[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= capacity
            assert k == 0 or r.length == capacity
            assert r.ids_crc32 == zlib.crc32(whole[at:at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in rows) // capacity)
    assert len(sequences) <= 1.02 * least + 1
