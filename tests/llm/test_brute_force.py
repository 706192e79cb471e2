"""Language profiles, apportionment, the audit of replicas and the pipeline's stages, each written out plainly."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablesmith.llm import language, mixing, near_dedup, warc
from test_llm_operators import rows, table
from test_near_dedup_families import partition

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return Counter()
    s = " " + " ".join(words) + " "
    return Counter([c for c in s if c != " "] + [s[i:i + 2] for i in range(len(s) - 1)] + [s[i:i + 3] for i in range(len(s) - 2)])


def ranking(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], len(g), [ord(c) for c in g]))[:size]


@pytest.mark.parametrize("size", [language.PROFILE, 30])
def test_language_by_plain_out_of_place_distance(spark, size):
    rng = random.Random(7)
    alphabets = {"xx": "abcdefgh ", "yy": "efghijkl é", "zz": "aeiou ßд"}
    docs = []
    for k in range(90):
        g = rng.choice(sorted(alphabets))
        own = "".join(rng.choice(alphabets[g] + alphabets[g][:3]) for _ in range(rng.randint(1, 150)))
        docs.append((k, rng.choice(["", "12 ", "İ! "]) + own, g if k % 9 else None))
    docs += [(90, None, "xx"), (91, "", "yy"), (92, "123 ?", "zz"), (93, "long text aé " * 20000, "xx"), (94, docs[3][1], "yy"), (94, docs[3][1], "yy")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    learned = defaultdict(Counter)
    for _, t, g in docs:
        if g is not None and t is not None:
            learned[g] += grams(t)
    profiles = {g: {x: r for r, x in enumerate(ranking(c, size))} for g, c in learned.items()}
    want = Counter()
    for i, t, _ in docs:
        own = ranking(grams(t or ""), size)
        if not own:
            want[i, "und", 0.0] += 1
            continue
        far = {g: sum(min(abs(p[x] - r), size) if x in p else size for r, x in enumerate(own)) for g, p in profiles.items() if p}
        best = min(far, key=lambda g: (far[g], g))
        want[i, best, round(1 - far[best] / (size * len(own)), 9)] += 1
    got = language.predict_language(d, language.train_profiles(d, size=size), size=size).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == want


def highest_quotients(votes, seats):
    """Seats one by one to the largest votes / (2 j + 1), ties to the smaller name."""
    won = Counter()
    for _ in range(seats if any(v > 0 for v in votes.values()) else 0):
        won[max(sorted(votes), key=lambda k: votes[k] / (2 * won[k] + 1))] += 1
    return won


def test_sainte_lague_by_plain_quotients(spark):
    rng = random.Random(3)
    for case in range(6):
        votes = {"p%03d" % k: float(rng.choice([0, 1, 7, 7, rng.randint(1, 10 ** rng.randint(1, 5))])) for k in range(rng.randint(1, 30))}
        seats = rng.choice([0, 1, 5, 37, 400])
        parts = spark.createDataFrame(list(votes.items()), "name string, votes double")
        got = mixing.sainte_lague(parts, [], "name", "votes", F.lit(seats).cast("long"), "won")
        won = highest_quotients(votes, seats)
        assert {r["name"]: r["won"] for r in got.collect()} == {k: won[k] for k in votes}, case


def test_mix_takes_each_sources_blocks(spark):
    """One shard a source: what is taken is its blocks, held to max_repeat times its size."""
    rows_ = rows()
    d = table(spark, rows_)
    res = mixing.mix(d, block_words=8).collect()
    by_source = defaultdict(list)
    for r in res:
        by_source[r.source_size, r.target].append(r)
    total = sum(s for s, _ in by_source)
    votes = {"%03d" % k: t for k, (_, t) in enumerate(sorted(by_source, key=lambda x: x[1]))}
    won = highest_quotients(votes, round(total / 8))
    for k, (size, target) in enumerate(sorted(by_source, key=lambda x: x[1])):
        assert sum(r.taken for r in by_source[size, target]) == min(won["%03d" % k] * 8, 3 * size)


def replica_rows(n=60):
    return [(i if i % 13 else None, f"http://a/{i}", "body %d " % i * (1 + i % 4), i) for i in range(n)]


def test_audit_tells_moved_changed_missing_and_added_records(spark):
    schema = "page_id long, url string, html string, place long, file string, seq int, hash string"
    make = lambda r: spark.createDataFrame([(*x, "f", 1, "h") for x in r], schema)
    a = replica_rows()
    b = list(a)
    b[5], b[7] = (b[7][0], b[7][1], b[7][2], 5), (b[5][0], b[5][1], b[5][2], 7)  # reordered
    b[20] = (b[20][0], b[20][1], b[20][2] + "x", 20)  # changed, so later offsets differ
    del b[30]  # missing: those behind it stand one place earlier
    b.append((59, "http://new", "added", 61))
    res = warc.fixity_audit(make(a), make(b), order="place", extra=True).collect()
    status = defaultdict(list)
    for r in res:
        status[r.status].append(r.page_id)
    first_file = [x[0] for x in a if x[0] is not None]
    assert status["missing"] == [30] and status["changed"] == [20] and status["added"] == [59]
    assert sorted(status["moved"]) == sorted([5, 7, *[i for i in first_file if i > 30]])
    assert len(res) == len(a) + 1 and all(r.intact == (r.status == "intact") for r in res)
    same = warc.fixity_audit(make(a), make(a), order="place", extra=True).collect()
    assert all(r.intact for r in same) and len(same) == len(a)


def test_audit_of_a_page_id_that_many_rows_share(spark):
    pages = [(1, f"http://a/{i}", "text %d" % i) for i in range(50)] + [(2, "u", "v"), (2, "u", "v"), (None, None, None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    m = warc.leaves(d, per_file=10)
    assert m.groupBy("file").count().agg(F.max("count")).first()[0] <= 10
    res = warc.fixity_audit(d, d.where("url is null or url != 'http://a/3'"), per_file=10).collect()
    assert len(res) == 53 and sum(not r.intact for r in res) == 1


@pytest.fixture(scope="module")
def pipeline_docs(spark):
    rng = random.Random(17)
    words = [w + str(k) for k in range(30) for w in ("alpha", "the", "of", "und")]
    data = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(60, 120)))) for k in range(60)]
    data += [(100 + k, data[k][1] + " tail") for k in range(5)] + [(200, None), (201, ""), (202, "x"), (7, data[7][1]), (None, data[9][1] + " end")]
    return spark.createDataFrame([(i, t, ["en", None][n % 2], ["s", "t", None][n % 3], len(t or ""), 1, "z") for n, (i, t) in enumerate(data)],
                                 "doc_id long, text string, lang string, source string, n_chars long, size int, _t string").repartition(3).cache()


def test_each_stage_of_the_pipeline(spark, pipeline_docs):
    import corpus_pipeline as cp
    from tablesmith.llm import bpe, quality
    tokenizers = pytest.importorskip("tokenizers")
    d = pipeline_docs
    row = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect())
    good = cp.quality_rules(spark, d, "")
    kept = Counter(r.doc_id for r in quality.judge(d).where("kept").collect())
    assert good.columns == COLUMNS and Counter(r.doc_id for r in good.collect()) == kept and not row(good) - row(d)
    one = cp.near_duplicates(spark, d, "")
    data = sorted(row(d), key=str)
    groups = partition([((i, t), t) for i, t, _, _ in data])
    assert one.columns == COLUMNS and one.count() == len(groups)
    assert {(r.doc_id, r.text or "") for r in one.collect()} == {min(((i, t or "") for i, t in g), key=lambda x: (x[0] is not None, x[0] or 0)) for g in groups}
    mixed = cp.mixture(spark, d, "")
    share = {}
    for r in mixing.mix(d, keep=("text",)).collect():
        taken, size = share.get((r.doc_id, r.text), (0, 0))
        share[r.doc_id, r.text] = (taken + r.taken, r["size"])
    want = {k: int(t / s + 0.5) for k, (t, s) in share.items() if s and int(t / s + 0.5)}
    assert mixed.columns == COLUMNS and Counter((r.doc_id, r.text) for r in mixed.collect()) == Counter(want)
    t = tokenizers.Tokenizer.from_file(cp.vocabulary())
    for r in cp.bpe_tokens(spark, d.limit(20), "").collect():
        assert r.n_tokens == len(r.ids) // 4 and bpe.load(cp.vocabulary()).decode(bytes(r.ids)).decode() == r.decoded
        assert r.decoded == t.decode([int.from_bytes(r.ids[k:k + 4], "little") for k in range(0, len(r.ids), 4)], skip_special_tokens=False)


def test_the_pipeline_runs_whole_on_edge_rows_and_on_nothing(spark, pipeline_docs, tmp_path):
    import corpus_pipeline as cp
    for name, d in (("rows", pipeline_docs), ("none", pipeline_docs.where("false"))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = cp.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == (name == "rows")
        # by hand: each stage on all that the one before kept
        stage = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, f) in enumerate(cp.STAGES):
            f(spark, stage, "").write.parquet(f"{tmp_path}/{name}/{k}")
            stage = spark.read.parquet(f"{tmp_path}/{name}/{k}")
        assert Counter((r.doc_id, r.decoded) for r in out) == Counter((r.doc_id, r.decoded) for r in stage.collect())


def test_verdict_follows_each_languages_own_limit(spark):
    from tablesmith.llm import quality
    rng = random.Random(2)
    text = lambda share, n: " ".join(rng.choice(["ab", "cd"]) if rng.random() < share else "w%06dlong" % rng.randrange(10**6) for _ in range(n))
    data = [(k, text(0.5, 200), "often") for k in range(40)] + [(100 + k, text(0.06, 400), "rare") for k in range(40)]
    data += [(1000, text(0, 200), "often"), (1001, text(0, 400), "rare")]
    res = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert not res[1000].kept and not res[1001].kept  # no common word at all, in either language
    assert res[1001].word_distance < 0.33 < res[1000].word_distance
    assert sum(r.kept for i, r in res.items() if i < 1000) == 80
    assert near_dedup.THRESHOLD == 0.8
