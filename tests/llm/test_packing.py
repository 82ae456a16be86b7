import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing

TEXTS = [
    None,
    "",
    "   \n\t ",
    "Hello, world! It's 2024 -- don't stop",
    "IT'S THE'RE x'sx 1234 ½²³ ªº ÇĞİıſß Straße",
    "a\u00a0b\u0085c\u2028d\x1ce\x0bf e\u0301 \u0301x",
    "ΣΑΣ Σ 漢字かな 😀👍 नमस्ते",
    "<|endoftext|> x <|startoftext|>",
    "$$$ ### %%% ***&&&,| a_b __ x@y.z http://a.b/c?d=e",
    "w" * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


def test_encoder_equals_whole_text(tokenizer):
    rng = random.Random(2)
    chars = "abcXYZ '’-._,!?0123456789\n\t\x0b\x1c\x1f\xa0\x85éßÀŠžĲŉǅİıſ²½ª٣Ωσς\u0301"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(1500)]
    encoder = packing.Encoder(packing.tokenizer_file())
    for t in texts:
        assert np.frombuffer(encoder.encode(t), np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def check(df, tokenizer, capacity=2048):
    rows = packing.pack(df, capacity=capacity).collect()
    ids = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in df.select("doc_id", "text").collect()]
    want = sorted((str(d), zlib.crc32(np.array(x, np.uint32).tobytes()), len(x)) for d, x in ids)
    assert sum(r.length for r in rows) == sum(n for _, _, n in want)
    by_doc = defaultdict(list)
    for d, x in ids:
        by_doc[str(d)].append(x)
    for r in rows:
        assert any(r.doc_tokens == len(x) and zlib.crc32(np.array(x[r.start : r.start + r.length], np.uint32).tobytes()) == r.ids_crc32 for x in by_doc[str(r.doc_id)])
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for off, length in sorted(pieces):
            assert off == at
            at += length
        assert at <= capacity
    return rows


def test_whole_table(spark, tokenizer, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = check(docs, tokenizer)
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    report = packing.packing_report(packing.pack(docs)).first()
    assert report.n_tokens == sum(r.length for r in rows) and report.padding_share < 0.03 and report.n_short_cut <= 0.05 * report.n_short


@pytest.mark.parametrize("capacity", [2048, 16, 100])
def test_edges(spark, tokenizer, capacity):
    rows = [(i % 7 if i % 5 else None, t, i) for i, t in enumerate(TEXTS * 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4), tokenizer, capacity)
    assert not packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect()
    with pytest.raises(TypeError):
        packing.pack(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def packed(sizes, capacity):
    """The bins [(doc, offset, start, length)] of documents of so many tokens, checked to hold each token once and without gaps."""
    packer = packing.Packer(capacity)
    for i, n in enumerate(sizes):
        packer.put(i, bytes(4 * n))
    packer.finish()
    bins, docs = defaultdict(list), defaultdict(list)
    for doc, start, length, _, _, bin_, offset in packer.rows():
        bins[bin_].append((offset, length, doc))
        docs[doc].append((start, length))
    for pieces, end in [(p, None) for p in bins.values()] + [(docs[i], n) for i, n in enumerate(sizes)]:
        at = 0
        for first, length, *_ in sorted(pieces):
            assert first == at and length > 0
            at += length
        assert at <= capacity if end is None else at == end
    return bins, docs


def test_classes_hold_a_fixed_number_of_whole_documents():
    for k in (1, 2, 3, 5, 7):
        n = 2048 // k
        bins, docs = packed([n] * (k * 6), 2048)
        assert len(bins) == 6 and all(len(b) == k for b in bins.values()) and all(len(d) == 1 for d in docs.values())


def test_long_documents_fill_the_slack():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 2048) for _ in range(900)] + [rng.randrange(2049, 9000) for _ in range(100)]
    rng.shuffle(sizes)
    bins, docs = packed(sizes, 2048)
    used = sum(sizes)
    assert len(bins) * 2048 < used * 1.005
    short = [i for i, n in enumerate(sizes) if n <= 2048]
    assert sum(len(docs[i]) > 1 for i in short) < 0.05 * len(short)


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2049], [700] * 400, [1100] * 300, [1] * 5000, [5000] * 40, list(range(1, 700)), list(range(700, 0, -1))])
def test_lopsided_sizes(sizes):
    bins, _ = packed(sizes, 2048)
    assert len(bins) * 2048 <= sum(sizes) * 1.02 + 2 * 2048
