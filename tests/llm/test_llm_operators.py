"""Operators against brute-force versions, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablesmith.llm import bpe, exact_dedup, language, line_dedup, mixing, near_dedup, quality, substring, suffix, warc

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, src string, n int, th long, kept string"


def rows():
    rng = random.Random(5)
    words = ["alpha", "be", "ga", "delta", "the", "of", "été", "x1"]
    base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(400)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "ab " * 2500), (4, "ab " * 900 + "q"), (5, "x" * 2000), (None, "one two"), (7, "one  two")]
    for k in range(40):
        b = list(base)
        for _ in range(rng.randint(0, 12)):
            b[rng.randrange(400)] = "w%d" % rng.randrange(50)
        s = rng.randrange(200)
        b = b[s:s + rng.randint(10, 220)]
        out.append((10 + k, "\n".join(" ".join(b[i:i + 7]) for i in range(0, len(b), 7))))
    out += [(80, out[20][1]), (81, out[20][1]), (20, out[18][1])]
    return out


def table(spark, data):
    return spark.createDataFrame([(i, t, ["en", "fr", None][k % 3], ["s", "t", None][k % 3], 0, 1, "c", 2, 3, "no")
                                  for k, (i, t) in enumerate(data)], SCHEMA)


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return table(spark, data).repartition(3).cache()


def got(df, cols):
    return Counter((r.doc_id, *[r[c] for c in cols]) for r in df.collect())


def test_exact_dedup(docs, data):
    groups = {}
    for i, t in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    res = exact_dedup.exact_dedup(docs).collect()
    assert len(res) == len(data)
    assert sum(r.kept for r in res) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in res:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)


def test_cuckoo_index_grows_and_deletes():
    index = exact_dedup.CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for k in keys:
        assert index.get(k) is None
        index.insert(k, [1, 1, 1])
    for k in keys[::2]:
        assert index.delete(k)
    assert all((index.get(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert len(index) == 1500 and not index.delete(keys[0])


def test_index_update_with_deletions(spark, docs):
    d = exact_dedup.digests(docs)
    gone = d.limit(1).select("digest")
    live = exact_dedup.update_index(d)
    left = exact_dedup.update_index(d.limit(0), live, gone)
    assert left.count() == live.count() - 1


def passages():
    """Documents of lines of their own around shared passages of 2 to 40 lines, each twice in other surroundings."""
    rng = random.Random(11)
    own = lambda n: ["own line %d" % rng.randrange(10**9) for _ in range(n)]
    out = [(0, None), (1, ""), (2, "\n\n\n"), (3, "\n \n\n"), (4, "a\na\na\na"), (5, "only line"), (6, "only line")]
    for n in range(2, 41):
        p = ["passage %d line %d" % (n, k) for k in range(n)]
        for k in range(2):
            out.append((100 * n + k, "\n".join(own(rng.randint(0, 4)) + p + own(rng.randint(0, 4)))))
    return [*out, (None, out[20][1]), (9000, "\n".join(["", "alone", "", *own(2)]))]


@pytest.mark.parametrize("min_lines,spread", [(2, 3), (3, 3), (2, 2), (2, 10**9)])
def test_line_dedup(spark, docs, data, min_lines, spread):
    shared = passages()
    for table_, rows_ in ((table(spark, shared), shared), (docs, data)):
        seen, want = {}, Counter()
        for i, t in sorted(rows_, key=lambda x: (x[0] is not None, x[0] or 0)):
            ls, gone = (t or "").split("\n"), set()
            for j in range(len(ls) - min_lines + 1):
                w = tuple(ls[j:j + min_lines])
                if any(WORD.search(x) for x in w) and seen.setdefault(w, (i, j)) != (i, j):
                    gone |= set(range(j, j + min_lines))
            want[i, len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone)] += 1
        have = got(line_dedup.line_dedup(table_, spread=spread, min_lines=min_lines), ["n_lines", "n_removed", "kept_text"])
        twice = {i for i, c in Counter(i for i, _ in rows_).items() if c > 1}  # ordered by text hash
        assert {k: v for k, v in have.items() if k[0] not in twice} == {k: v for k, v in want.items() if k[0] not in twice}


def test_most_of_a_long_passage_goes_as_whole_chunks(spark):
    rows_ = [(i, t) for i, t in passages() if i is not None and 2000 <= i < 4100]
    base = line_dedup.keyed(table(spark, rows_))
    gone = {r.doc_id: sum(c.n for c in r.chunks) for r in line_dedup.repeated_chunks(base).collect()}
    later = [i for i, _ in rows_ if i % 100 == 1]
    assert sum(gone.get(i, 0) for i in later) > 0.5 * sum(i // 100 for i in later)
    assert not any(gone.get(i) for i, _ in rows_ if i % 100 == 0)


def test_pipeline_removes_passages_of_every_length(spark):
    import corpus_pipeline

    shared = passages()
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_lines(spark, table(spark, shared), "").collect()}
    for n in range(2, 41):
        assert sum("passage %d line" % n in (left[i] or "") for i in (100 * n, 100 * n + 1, None)) <= 1


def test_substring_dedup(docs, data):
    seen, want = {}, Counter()
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [i for i, _ in data]
    for i, t in order:
        ws, gone = WORD.findall(t or ""), set()
        for j in range(len(ws) - 19):
            if seen.setdefault(tuple(ws[j:j + 20]), (i, j)) != (i, j):
                gone |= set(range(j, j + 20))
        left = " ".join(w for k, w in enumerate(ws) if k not in gone)
        want[i, len(ws), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    have = got(substring.substring_dedup(docs, digest=True), ["n_words", "n_removed", "kept_sha256"])
    twice = {i for i in ids if ids.count(i) > 1}  # rows that share a doc_id are ordered by text hash
    assert {k: v for k, v in have.items() if k[0] not in twice} == {k: v for k, v in want.items() if k[0] not in twice}


@pytest.mark.parametrize("group_rows", [suffix.GROUP_ROWS, 3, 1])
def test_suffix_dedup(docs, data, group_rows):
    w, want = 400, Counter()
    raw = [(i, (t or "").encode()) for i, t in data]
    count = Counter(b[j:j + w] for _, b in raw for j in range(len(b) - w + 1))
    for i, b in raw:
        m = bytearray(len(b))
        for j in range(len(b) - w + 1):
            if count[b[j:j + w]] > 1:
                m[j:j + w] = b"\1" * w
        spans = sum(1 for j in range(len(m)) if m[j] and (j == 0 or not m[j - 1]))
        want[i, len(b), sum(m), spans, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()] += 1
    assert got(suffix.suffix_dedup(docs, digest=True, group_rows=group_rows), ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(2)
    items = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    runs = [sorted(items[k::7]) for k in range(7)]
    coded = [suffix.read_run(suffix.front_code([(s, b"", 0, 0, 0, False) for s in r])) for r in runs]
    merged = list(suffix.merge(coded))
    assert [s for _, s, _ in merged] == sorted(items)
    assert all(lcp == suffix.common_prefix(a[1], s) for a, (lcp, s, _) in zip(merged, merged[1:]))


def test_near_dedup(docs, data):
    sh = [near_dedup.shingles(near_dedup.word_values((t or "").encode())) for _, t in data]
    res = near_dedup.near_dedup(docs).collect()
    assert len(res) == len(data)
    cls = {r.doc_id: r.class_id for r in res if r.doc_id != 20}
    for a in range(len(data)):
        for b in range(a):
            i, j = data[a][0], data[b][0]
            if 20 not in (i, j) and near_dedup.similarity(sh[a], sh[b]) >= 0.8:
                assert cls[i] == cls[j]
    assert sum(r.kept for r in res) == len({(r.class_id) for r in res})


def family(n=160):
    """Texts that share a template and stay below 0.8; each of the first half has one partner in the second above it."""
    rng = random.Random(9)
    own = lambda k: ["o%d" % rng.randrange(10**9) for _ in range(k)]
    template = own(91)
    pairs = [own(4) for _ in range(n // 2)]
    order = rng.sample(range(n // 2), n // 2)
    return [(k, " ".join(template + pairs[p] + own(9))) for k, p in enumerate([*range(n // 2), *order])]


def test_near_dedup_links_inside_a_family_below_the_threshold(spark):
    rows_ = family()
    sh = [near_dedup.shingles(near_dedup.word_values(t.encode())) for _, t in rows_]
    keys = [set(enumerate(near_dedup.sketches(x).tolist())) for x in sh]
    cls = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table(spark, rows_)).collect()}
    linked = [(a, b) for a in range(len(sh)) for b in range(a) if near_dedup.similarity(sh[a], sh[b]) >= 0.8 and keys[a] & keys[b]]
    assert len(linked) == len(rows_) // 2
    assert all(cls[a] == cls[b] for a, b in linked)
    assert len(set(cls.values())) == len(rows_) // 2


def test_aligned_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.sample(range(14), rng.randint(0, 12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 99) == best[-1][-1]


def test_quality_counts(docs, data):
    want = Counter()
    for i, t in data:
        t = t or ""
        ws = WORD.findall(t)
        tri = [tuple(ws[k:k + 3]) for k in range(len(ws) - 2)]
        c, cov = Counter(tri), set()
        for k, x in enumerate(tri):
            if c[x] > 1:
                cov |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(ws) < 50 or 100 * len(cov) > 50 * len(ws)
        want[i, len(ws), sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cov), failed] += 1
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    res = quality.judge(docs)
    assert got(res, cols) == want
    assert res.where("kept and base_failed").count() == 0


def test_quality_rejects_wrong_language_and_random_words(spark):
    rng = random.Random(4)
    common = {"en": "the of and to in is it was for on as at by he".split(), "de": "der die und das ist ein zu von mit auf im den es so".split()}
    rare = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9)))
    text = lambda lang, share: " ".join(rng.choice(common[lang]) if rng.random() < share else rare() for _ in range(300))
    rows_ = [(k, text(lang, 0.4), lang) for lang, ids in (("en", range(60)), ("de", range(60, 120))) for k in ids]
    rows_ += [(1000, text("de", 0.4), "en"), (1001, text("en", 0.4), "de"), (1002, text("en", 0), "en"), (1003, text("de", 0), "de")]
    res = quality.judge(spark.createDataFrame(rows_, "doc_id long, text string, lang string")).collect()
    assert not any(r.base_failed for r in res)
    assert {r.doc_id for r in res if not r.kept} == {1000, 1001, 1002, 1003}
    assert all(r.class_distance <= quality.MAX_CLASS_DISTANCE for r in res)


def test_bpe_equals_the_library(docs, data):
    tokenizers = pytest.importorskip("tokenizers")
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    t = tokenizers.Tokenizer.from_file(path)
    own = bpe.load(path)
    rng = random.Random(1)
    letters = ["a", "b", "th", "ing", " ", "\n", "'s", "İ", "Σ", "é", "é", "²", "中文", "🎉", "<|endoftext|>", "<|", "\x1c", "\x85", "_", "#$%", "12"]
    for text in [x or "" for _, x in data] + ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(2000)]:
        e = t.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == e
        assert own.decode(ids).decode("utf-8", "replace") == t.decode(e, skip_special_tokens=False)
    assert bpe.encode_documents(docs, path, digest=True).count() == len(data)


def test_mixing(docs, data):
    res = mixing.mix(docs, block_words=4).collect()
    assert len(res) == len(data) and all(0 <= r.taken <= 3 * r["size"] for r in res)
    total = sum(len(WORD.findall(t or "")) for _, t in data)
    by_target = {}
    for r in res:
        by_target.setdefault((r.target, r.source_size), []).append(r.taken)
    assert abs(sum(t for t, _ in by_target) - total) < 1e-6
    assert all(abs(sum(v) - t) <= 4 for (t, _), v in by_target.items())
    assert sorted(map(tuple, res), key=str) == sorted(map(tuple, mixing.mix(docs, block_words=4).collect()), key=str)


def test_language(spark, docs, data):
    d = spark.createDataFrame([(i, t, g, 1) for i, (t, g) in enumerate(
        [("the house of the man and the dog", "en"), ("la maison de la femme et le chien", "fr")] * 3 + [(None, "en"), ("12 !", None), ("", "fr")])],
        "doc_id long, text string, lang string, score int")
    p = language.train_profiles(d)
    res = {r.doc_id: r for r in language.predict_language(d, p).collect()}
    assert [res[i].lang_pred for i in range(9)] == ["en", "fr"] * 3 + ["und"] * 3
    assert all(0 <= r.score <= 1 for r in res.values())
    assert {r.lang_pred for r in language.predict_language(docs, p.limit(0)).collect()} == {"und"}


def test_warc_audit_finds_all_damage(spark):
    pages = spark.createDataFrame([(i if i % 17 else None, f"http://a/{i}", "body %d " % i * 9) for i in range(1, 2300)] + [(5, None, None)],
                                  "page_id long, url string, html string")
    bad = warc.damaged(pages, 53)
    res = warc.fixity_audit(pages, bad).collect()
    assert len(res) == 2300
    changed = {r.page_id for r in pages.exceptAll(bad).collect()}
    assert {r.page_id for r in res if not r.intact} == changed and changed


def test_empty_tables(spark):
    e = table(spark, [(1, "a")]).limit(0)
    path = str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    for df in (exact_dedup.exact_dedup(e), line_dedup.line_dedup(e), substring.substring_dedup(e), suffix.suffix_dedup(e),
               near_dedup.near_dedup(e), quality.judge(e), bpe.encode_documents(e, path), mixing.mix(e),
               language.predict_language(e, language.train_profiles(e))):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.fixity_audit(pages, pages).count() == 0
