"""Families of texts around the threshold: no link lost against brute force, and no more pairs than in proportion."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import near_dedup
from test_llm_operators import family, table


def mutants(n, edits, seed=5):
    """Copies of one base with up to `edits` words replaced, dropped or added."""
    rng = random.Random(seed)
    base = ["b%d" % k for k in range(140)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = "m%d" % rng.randrange(10**9)
            elif kind == 1:
                del w[at:at + rng.randint(1, 3)]
            else:
                w[at:at] = ["i%d" % rng.randrange(10**9) for _ in range(rng.randint(1, 3))]
        out.append((k, " ".join(w)))
    return out


def partition(rows_):
    """Classes by brute force over all pairs."""
    sh = [near_dedup.shingles(near_dedup.word_values((t or "").encode())) for _, t in rows_]
    root = list(range(len(sh)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a in range(len(sh)):
        for b in range(a):
            if find(a) != find(b) and near_dedup.similarity(sh[a], sh[b]) >= 0.8:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(sh)):
        groups.setdefault(find(k), set()).add(rows_[k][0])
    return {frozenset(g) for g in groups.values()}


def classes_of(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.class_id, set()).add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("edits", [3, 9])
def test_mutants_of_one_text_fall_into_the_classes_of_brute_force(spark, edits):
    rows_ = mutants(220, edits)
    assert classes_of(near_dedup.near_dedup(table(spark, rows_))) == partition(rows_)


def labelled(spark, rows_):
    """early_symbols of texts none of which are linked yet."""
    x = F.struct(F.col("doc_id"), F.lit(0).cast("long").alias("th"))
    involved = spark.createDataFrame(rows_, "doc_id long, text string").select(x.alias("x"), "text", F.col("doc_id").alias("xid"))
    early = near_dedup.early_symbols(involved.select("xid", "x"), involved.select("x", "text"), 0.8)
    return early.withColumn("root", F.struct(F.col("xid").alias("doc_id"), F.lit(0).cast("long").alias("th")))


def test_pairs_of_a_family_below_the_threshold_grow_in_proportion(spark):
    counts = []
    for n in (80, 160, 320):
        now = labelled(spark, family(n))
        counts.append((near_dedup.middle_pairs(now, 0.8).count(), near_dedup.all_pairs(now, 0.8).count()))
    assert [b for _, b in counts] == [40, 80, 160]  # the planted pairs alone
    assert all(a <= n for (a, _), n in zip(counts, (80, 160, 320)))


def test_early_symbols_lose_no_pair_that_can_be_linked(spark):
    rows_ = mutants(60, 9, seed=2) + [(1000 + k, t) for k, t in family(40)] + [(2000, ""), (2001, "one two three")]
    sh = [set(near_dedup.shingles(near_dedup.word_values(t.encode())).tolist()) for _, t in rows_]
    found = {(r.a, r.b) for r in near_dedup.all_pairs(labelled(spark, rows_), 0.8).collect()}
    for a in range(len(sh)):
        for b in range(a):
            both = len(sh[a] & sh[b])
            if both and both / (len(sh[a]) + len(sh[b]) - both) >= 0.8:
                i, j = rows_[a][0], rows_[b][0]
                assert (max(i, j), min(i, j)) in found


def test_stored_tables_are_deleted(spark, tmp_path):
    import os
    from tablesmith.llm.common import discard, stored
    made = []
    stored(spark.range(5), "gone", made)
    path = made[0].removeprefix("file:")
    assert os.path.isdir(path)
    discard(spark, made)
    assert not os.path.isdir(path) and made == []


def test_near_dedup_has_no_pairs_without_texts(spark):
    assert np.array_equal(near_dedup.shingles(near_dedup.word_values(b"")), np.zeros(0, np.uint64))
    res = near_dedup.near_dedup(table(spark, [(1, None), (2, ""), (3, "a b")])).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in res} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
