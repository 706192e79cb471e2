"""The filter audit against a simulation of every order, document by document."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

from tablesmith.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, mask string, part int, n long, good string, first int"


def rows():
    rng = random.Random(3)
    out = [(0, None, "en"), (1, "", "en"), (2, " \n\t", None), (None, "", "fr"), (3, "A" * 40000, "de"), (4, "x " * 60000, "de")]
    kinds = ["same " * 300, " ".join("w%d" % k for k in range(250)), "Abc DEF $1 " * 80, " ".join("v%d" % k for k in range(199)),
             " ".join("Q%d" % k for k in range(400)), "y%d " % 5 * 210 + "|"]
    for k in range(200):
        t = rng.choice(kinds) + rng.choice(["", " tail", " %d" % k, " &"])
        out.append((10 + k, t, rng.choice(["en", "en", "fr", None])))
    return [*out, (12, out[8][1], "en"), (15, out[15][1], "en"), (15, out[15][1], "en")]


def fails(rows_):
    first = {}
    key = lambda i: (i is not None, i or 0)
    for i, t, _ in rows_:
        t = t or ""
        first[t] = min(first.get(t, key(i)), key(i))
    for i, t, g in rows_:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
             "D": any(c in "#$%&*|" for c in t), "E": key(i) > first[t]}
        yield i, g or "", {k for k, v in f.items() if v}


def expected(rows_, good, toxic):
    by_part = defaultdict(list)
    for i, part, f in fails(rows_):
        by_part[part].append((f, i in good, i in toxic))
    want = set()
    for part, ds in by_part.items():
        steps, sums = [], Counter()
        for order in permutations("ABCDE"):
            live = ds
            for k, x in enumerate(order, 1):
                gone = [d for d in live if x in d[0]]
                left = [d for d in live if x not in d[0]]
                sums[x] += len(gone)
                steps.append((part, "".join(order), k, x, len(left), len(gone), sum(x in d[0] for d in ds) - len(gone),
                              sum(d[0] == {x} for d in ds), sum(d[1] for d in gone), sum(d[2] for d in gone)))
                live = left
        want |= {(*s[:3], *s[4:], sums[s[3]]) for s in steps}
    return want


def test_audit_equals_a_simulation_of_all_orders(spark):
    rows_ = rows()
    good, toxic = set(range(0, 220, 3)), set(range(0, 220, 7))
    labels = [(i, int(i in good), int(i in toxic), "x") for i in range(0, 230)] + [(0, 0, 0, "y"), (None, 1, 1, "z"), (9, None, None, None)]
    d = spark.createDataFrame([(i, t, g, "m", 1, 2, "g", 3) for i, t, g in rows_], SCHEMA).repartition(3)
    res = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    assert [c for c, _ in res.dtypes] == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in res.collect()]
    assert len(got) == len(set(got)) == 600 * len({g for _, _, g in rows_})
    assert set(got) == expected(rows_, good, toxic)


def test_shapley_of_random_games():
    rng = random.Random(8)
    for m in (2, 3, 5):
        game = [0, *(rng.randrange(1000) for _ in range((1 << m) - 1))]
        want = [Fraction(0)] * m
        for order in permutations(range(m)):
            s = 0
            for i in order:
                want[i] += Fraction(game[s | 1 << i] - game[s], factorial(m))
                s |= 1 << i
        assert filter_audit.shapley(game, m) == want


def test_audit_of_empty_tables(spark):
    d = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d, none).count() == 0
    one = spark.createDataFrame([(1, None, None, "m", 1, 2, "g", 3)], SCHEMA)
    res = filter_audit.audit(one, none).collect()
    assert len(res) == 600 and {r.part for r in res} == {""} and sum(r.removed for r in res) == 120
