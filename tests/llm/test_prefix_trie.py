"""The burst trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablesmith.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn long, role string, text string, key string, path int, n long, words string, container string"


def rows():
    rng = random.Random(13)
    out = [(7, None, None, None), (7, 3, "user", ""), (None, 1, "user", "lost"), (2000, 0, "user", "x " * 50000)]
    for c in range(0, 140):
        if c in (40, 99):
            continue
        common = [("user", "hello there"), ("assistant", "hi what can I do"), ("user", "one two")][:rng.randint(0, 3)]
        own = [(rng.choice(["user", None]), rng.choice(["a b", "c", "", None, "d e f"])) for _ in range(rng.randint(0, 5))]
        for k, (r, t) in enumerate(common + own):
            out.append((c, 2 * k - 1, r, t))
    out += [(c, k, "user", "again and again %d" % k) for c in (160, 161, 180, 181) for k in range(40)]
    out += [(c, k, "user", "always the same") for c in range(200, 240) for k in range(3)]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, "k", 1, 2, "w", "c") for r in data], SCHEMA).repartition(3)


def rebuild(data):
    convs = defaultdict(list)
    for c, turn, r, t in data:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, r or "", t or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def expected(data):
    members = defaultdict(list)
    convs = rebuild(data)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("capacity", [prefix_trie.CAPACITY, 1, 3, 20])
def test_trie_equals_a_dictionary_of_prefixes(spark, capacity):
    data = rows()
    res = prefix_trie.conversation_trie(table(spark, data), capacity)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in res.collect()) == expected(data)


def test_ends_are_hashed_over_stretches(spark):
    ids = [("a", k * 37 % 5000) for k in range(5000)] + [("b", 12), ("c", -3), ("c", 10), ("c", 9)]
    d = spark.createDataFrame(ids, "key string, conv_id long").select(F.col("key").cast("binary").alias("key"), "conv_id")
    want = defaultdict(list)
    for k, c in ids:
        want[k].append(c)
    for size in (1, 50, 1 << 20):
        got = {bytes(r.key).decode(): r.ends_sha256 for r in prefix_trie.end_digests(d, size).collect()}
        assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_small_and_empty_tables(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    for data in ([(3, 1, "user", "a b c")], [(41, 0, None, None)], [(0, 0, "u", "x"), (0, 0, "u", "x"), (1, 0, "u", "x")]):
        res = prefix_trie.conversation_trie(table(spark, data))
        assert Counter(tuple(r[c] for c in COLUMNS) for r in res.collect()) == expected(data)
