"""Packing: every id once, full windows, and the neighbours a plain BM25 gives."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablesmith.llm import batch_bpe, bpe, packing

SCHEMA = "doc_id long, text string, ids string, unit int, shard int, start int, salt long"


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("tokenizers")
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def rows():
    rng = random.Random(21)
    words = "river mountain of the code python cat dog water engine 12 über".split()
    out = [(0, None), (1, ""), (2, " \n "), (None, "no id"), (3, "long text " * 9000), (4, " ".join(["half"] * 1023))]
    for k in range(120):
        kind = rng.sample(words, 4)
        out.append((10 + k, " ".join(rng.choice(kind) for _ in range(rng.randint(1, 900)))))
    return [*out, (12, out[8][1]), (12, out[8][1]), *((300 + k, "the same text in many rows " * 20) for k in range(60))]


def encoded(data, vocabulary):
    import tokenizers
    t = tokenizers.Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in data]


def check(pieces, docs, width):
    """Every id in one piece, sequences gapless and full or a power of two."""
    have, sequences = Counter(), defaultdict(list)
    texts = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        texts[p.doc_id, p.doc_tokens].append((p.start, ids))
    for doc_id, ids in docs:
        have[doc_id, tuple(ids)] += 1
    for (doc_id, n), found in texts.items():
        same = [v for k, v in have.items() if k[0] == doc_id and len(k[1]) == n]
        whole = [k[1] for k in have if k[0] == doc_id and len(k[1]) == n]
        assert len(whole) == 1  # the fixtures have no other texts of one id and length
        covered = Counter()
        for start, ids in found:
            assert tuple(ids) == whole[0][start:start + len(ids)]
            covered.update(range(start, start + len(ids)))
        assert covered == Counter({k: same[0] for k in range(n)})
    assert {(i, n) for i, n in texts} == {(i, len(x)) for i, x in docs}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == width or (at < width and at & (at - 1) == 0)


@pytest.mark.parametrize("width,shard_tokens", [(2048, packing.SHARD_TOKENS), (256, 4000), (64, 1)])
def test_every_id_is_packed_once(spark, vocabulary, width, shard_tokens):
    data = rows()
    d = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in data], SCHEMA).repartition(4)
    got = packing.pack(d, vocabulary, width=width, shard_tokens=shard_tokens).collect()
    check(got, encoded(data, vocabulary), width)
    short = sum(1 for s in {p.sequence_id: 1 for p in got})
    assert short * width >= sum(p.length for p in got)


def plain_fill(docs, width):
    """The same packing, BM25 written out term by term."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))

    def score(seed, doc):
        tf, s = Counter(doc), 0.0
        for t in set(seed):
            idf = max(0.0, math.log((n - df[t] + 0.5) / (df[t] + 0.5)))
            s += idf * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(doc) / mean))
        return round(s, 6)

    start, left, out, seed = [0] * n, list(map(len, docs)), [], None
    while any(left):
        if seed is None:
            seed = next(k for k in range(n) if left[k])
        row, room = [(seed, start[seed], left[seed])], width - left[seed]
        left[seed] = 0
        ranked = sorted((k for k in range(n) if left[k]), key=lambda k: (-score(docs[seed], docs[k]), k))
        seed = None
        for k in ranked:
            if left[k] <= room:
                row.append((k, start[k], left[k]))
                room -= left[k]
                left[k] = 0
        cut = next((k for k in ranked if left[k]), None)
        if room and cut is not None:
            row.append((cut, start[cut], room))
            start[cut] += room
            left[cut] -= room
            seed = cut
        out.append(row)
    return out


def test_windows_take_the_best_unused_neighbours():
    rng = random.Random(6)
    topics = [rng.sample(range(600), 25) for _ in range(6)]
    for _ in range(5):
        docs = [[rng.choice(rng.choice([topics[k % 6], range(600)])) for _ in range(rng.randint(1, 90))] for k in range(60)]
        df = np.bincount([t for d in docs for t in set(d)], minlength=600)
        scorer = packing.Scorer(df, len(docs), sum(map(len, docs)) / len(docs))
        got = packing.fill([np.array(d, "<u4").tobytes() for d in docs], scorer, 128)
        want = plain_fill(docs, 128)
        last = [x for s in got[len(want) - 1:] for x in s]
        assert got[:len(want) - 1] == want[:-1]
        assert sum(n for _, _, n in last) == sum(n for _, _, n in want[-1])


def test_statistics_count_all_units(spark, vocabulary):
    data = rows()
    d = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in data], SCHEMA).repartition(4)
    rest = [x[len(x) // 2048 * 2048:] for _, x in encoded(data, vocabulary)]
    rest = [x for x in rest if x]
    all_units = packing.units(d, vocabulary)
    scorer = packing.statistics(all_units)
    want = packing.Scorer(np.bincount([t for x in rest for t in set(x)]), len(rest), sum(map(len, rest)) / len(rest))
    assert np.array_equal(scorer.idf, want.idf) and scorer.mean == want.mean


def test_shards_hold_their_share():
    dealt, count = packing.shards({3: 10, 4: 95, 9: 1000, 10: 5, 11: 40}, 100)
    assert dealt == [(3, 0, 1), (4, 1, 1), (9, 2, 10), (10, 12, 1), (11, 12, 1)] and count == 13
    assert packing.shards({}, 100) == ([], 1)


def test_batches_equal_the_library(vocabulary, monkeypatch):
    import tokenizers
    t = tokenizers.Tokenizer.from_file(vocabulary)
    parts = ["a", "The", "ing", " ", "\n", "  ", "'s", "İ", "Σ", "é", "e\u0301", "\u0301", "²", "中文", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", "\u2000",
             "_", "#$%", "12", "can't,", "'", "ll", "'re", "'ve", "r", "''s", "ÿ", "Ž", "×", "÷", "ß", "ẞ", "ª", "Ⅷ", "\u0131", "\u01c5", "x" * 40, "Ⱥ"]
    plain = [p for p in parts if not batch_bpe.OTHER(p)]
    rng = random.Random(1)
    for slots, size in ((1 << 21, 1 << 21), (1 << 4, 40), (1 << 4, 1)):
        monkeypatch.setattr(batch_bpe, "SLOTS", slots)
        monkeypatch.setattr(batch_bpe, "BATCH_BYTES", size)
        monkeypatch.setattr(batch_bpe, "KEPT_IDS", 5000 if size < 100 else 1 << 23)
        own = batch_bpe.BatchBpe(bpe.load(vocabulary))
        texts = ["".join(rng.choices(parts if k % 4 == 0 else plain, k=rng.randint(0, 14))) for k in range(4000)]
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_halved_lengths():
    assert [[n for *_, n in s] for s in packing.halved([(0, 0, 5), (1, 2, 6)], 11)] == [[5, 3], [2], [1]]


def test_empty_and_whole_windows_only(spark, vocabulary):
    e = spark.createDataFrame([], SCHEMA)
    assert packing.pack(e, vocabulary).count() == 0
    d = spark.createDataFrame([(1, " ".join(["cat"] * 15), "", 0, 0, 0, 0), (2, " ".join(["dog"] * 31), "", 0, 0, 0, 0)], SCHEMA)
    got = packing.pack(d, vocabulary, width=16, shard_tokens=16).collect()
    assert sorted((p.doc_id, p.start, p.length, p.doc_tokens, p.offset) for p in got) == [(1, 0, 16, 16, 0), (2, 0, 16, 32, 0), (2, 16, 16, 32, 0)]
    assert len({p.sequence_id for p in got}) == 3
