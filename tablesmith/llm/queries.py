"""One query per operator over the whole `documents` (or `pages`) table, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.bpe import encode_documents
from tablesmith.llm.common import documents
from tablesmith.llm.exact_dedup import exact_dedup
from tablesmith.llm.filter_audit import audit
from tablesmith.llm.language import held_out, predict_language, train_profiles
from tablesmith.llm.line_dedup import line_dedup
from tablesmith.llm.mixing import mix
from tablesmith.llm.near_dedup import near_dedup
from tablesmith.llm.packing import pack
from tablesmith.llm.prefix_trie import conversation_trie
from tablesmith.llm.quality import judge
from tablesmith.llm.substring import substring_dedup
from tablesmith.llm.suffix import suffix_dedup
from tablesmith.llm.warc import damaged, fixity_audit


def vocabulary() -> str:
    """Place of the public tokenizer file used by the queries; the operator takes any path."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(documents(spark, sf_dir))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    profiles = train_profiles(d.where(~held_out()))
    out = predict_language(d, profiles)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).drop("th")


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return fixity_audit(pages, damaged(pages)).drop("status")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), digest=True)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), vocabulary(), digest=True)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), digest=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(documents(spark, sf_dir))
    return d.withColumn("class_distance", F.round("class_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")).drop("key")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_exact_dedup, op3_language, op4_near_dedup, op5_warc_audit, op6_substring_dedup, op7_bpe,
    op8_mixing, op9_suffix_dedup, op10_quality, op11_prefix_trie, op12_packing, op13_filter_audit)}

ORACLE = {
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
        k AS (SELECT doc_id, i, n, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i
                     ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS key FROM x),
        l AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1 AS later FROM k WHERE i <= n - 19),
        c AS (SELECT x.doc_id, x.i, x.word, coalesce(max(later::INT) OVER (PARTITION BY x.doc_id ORDER BY x.i
                     ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
              FROM x LEFT JOIN l ON l.doc_id = x.doc_id AND l.i = x.i),
        g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                     coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op9_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399, 512)) AS block FROM d WHERE len(x) >= 800),
        c AS (SELECT doc_id, block, least(512, len(x) // 2 - 399 - block) AS k, substr(x, 2 * block + 1, 2 * (512 + 399)) AS part FROM s),
        w AS (SELECT doc_id, block + j AS i, md5(substr(part, 2 * j + 1, 800)) AS key FROM (SELECT doc_id, block, part, unnest(range(0, k)) AS j FROM c)),
        r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY key) > 1),
        o AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400, -1) AS fresh FROM r),
        g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
        p AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, run),
        q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
        m AS (SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(sum(b - a), 0) AS n_removed, count(a) AS n_spans,
                     coalesce(string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') ||
                     substr(any_value(x), 2 * coalesce(max(b), 0) + 1) AS kept
              FROM d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id, len(x))
        SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM m""",
    "op10_quality": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT *, len(w) AS n, length(list_aggregate(list_prepend('', w), 'string_agg', '')) AS wc,
                     regexp_replace(t, '[\p{Ll}\x20\x09-\x0D]+', '', 'g') AS o,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
        y AS (SELECT *, length(o) - length(regexp_replace(o, '\p{Lu}+', '', 'g')) AS c1, length(o) - length(regexp_replace(o, '\p{Nd}+', '', 'g')) AS c2,
                     length(o) - length(regexp_replace(o, '[.,;:!?''()-]+', '', 'g')) AS c3,
                     length(o) - length(regexp_replace(o, '[#*$%&|<>]+', '', 'g')) AS c4 FROM b),
        c AS (SELECT *, [c1, c2, c3, c4, wc - length(o), length(o) - c1 - c2 - c3 - c4] AS cls,
                     list_filter(list_transform(w, lambda x: lower(x)), lambda x: regexp_full_match(x, '\p{L}{1,4}')) AS short FROM y),
        x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS key FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM c WHERE n >= 3)),
        r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, key) > 1),
        rw AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
        rc AS (SELECT lang, sum(n) AS words, [sum(cls[1]), sum(cls[2]), sum(cls[3]), sum(cls[4]), sum(cls[5]), sum(cls[6])] AS rcls FROM c GROUP BY lang),
        cw AS (SELECT lang, word, count(*) AS m FROM (SELECT lang, unnest(short) AS word FROM c) GROUP BY lang, word
               QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) <= 24),
        ct AS (SELECT lang, list(word ORDER BY m DESC, word) AS common, list(m ORDER BY m DESC, word) AS ms, sum(m) AS total FROM cw GROUP BY lang),
        ref AS (SELECT rc.lang, rcls, coalesce(common, []) AS common, list_append(coalesce(ms, []), (words - coalesce(total, 0))::BIGINT) AS rw,
                       CASE WHEN words > 0 THEN coalesce(total, 0) / words ELSE 0 END AS share
                FROM rc LEFT JOIN ct ON ct.lang = rc.lang),
        hits AS (SELECT c.doc_id, c.lang, c.n, cls, rcls, ref.rw AS rw, share, list_transform(common, lambda z: len(list_filter(short, lambda q: q = z))) AS hits
                 FROM c JOIN ref ON ref.lang = c.lang),
        kinds AS (SELECT doc_id, 'c' AS kind, cls::DOUBLE[] AS a, rcls::DOUBLE[] AS b FROM hits
                  UNION ALL SELECT doc_id, 'w', list_append(hits, (n - coalesce(list_sum(hits), 0))::BIGINT)::DOUBLE[], rw::DOUBLE[] FROM hits
                  UNION ALL SELECT doc_id, 'n', list_append(list_transform(hits, lambda z: 0.0), 1.0)::DOUBLE[], rw::DOUBLE[] FROM hits),
        bins AS (SELECT doc_id, kind, unnest(a) / list_sum(a) AS x, unnest(b) / list_sum(b) AS y FROM kinds WHERE list_sum(a) > 0 AND list_sum(b) > 0),
        js AS (SELECT doc_id, kind, round(sqrt(greatest(0, sum((CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END
                     + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2))), 9) AS dist FROM bins GROUP BY ALL),
        dist AS (SELECT doc_id, coalesce(max(dist) FILTER (kind = 'c'), 0) AS cd, coalesce(max(dist) FILTER (kind = 'w'), 0) AS wd,
                        coalesce(max(dist) FILTER (kind = 'n'), 0) AS nd FROM js GROUP BY doc_id),
        out AS (SELECT c.doc_id, c.n, c.wc, c.c4, len(lines) - len(list_distinct(lines)) AS dup, coalesce(n_repeat, 0) AS rep,
                       coalesce(cd, 0.0) AS cd, coalesce(wd, 0.0) AS wd, coalesce(nd, 0.0) AS nd, share
                FROM c JOIN ref ON ref.lang = c.lang LEFT JOIN rw ON rw.doc_id = c.doc_id LEFT JOIN dist ON dist.doc_id = c.doc_id)
        SELECT doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, c4::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words,
               round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, n < 50 OR 100 * rep > 50 * n AS base_failed,
               NOT (n < 50 OR 100 * rep > 50 * n) AND NOT (wc >= 200 AND cd > 0.30) AND NOT (n * share >= 5 AND wd > 0.94 * nd) AS kept FROM out""",
    "op1_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
        n AS (SELECT *, lead(i) OVER w AS j, lead(line) OVER w AS below FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, below ORDER BY doc_id, i) > 1 AS later FROM n
              WHERE j IS NOT NULL AND (regexp_matches(line, '[^\x20\x09-\x0D]') OR regexp_matches(below, '[^\x20\x09-\x0D]'))),
        g AS (SELECT doc_id, i FROM r WHERE later UNION SELECT doc_id, i + 1 FROM r WHERE later),
        f AS (SELECT l.*, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op5_warc_audit": r"""
        WITH p AS (SELECT page_id, url, html, length(html) // 2 AS half,
                     ('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT % 53 AS pick FROM pages),
        q AS (SELECT *, CASE WHEN pick = 0 AND half > 0 THEN substr(html, 1, half - 1) || chr(1) || substr(html, half + 1)
                             WHEN pick = 1 THEN substr(html, 1, half) ELSE html END AS other FROM p),
        r AS (SELECT page_id, page_id // 1000 AS f,
                     'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) ||
                     'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) ||
                     chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
                     'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) ||
                     'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(other) ||
                     chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) AS rec2
                   FROM q),
        m AS (SELECT page_id, f, sha256(rec) AS h, rec = rec2 AS intact, strlen(rec) AS len,
                     row_number() OVER (PARTITION BY f ORDER BY page_id) - 1 AS seq,
                     (sum(strlen(rec)) OVER (PARTITION BY f ORDER BY page_id))::BIGINT AS stop FROM r),
        l1 AS (SELECT f, seq // 10 AS seq, min(stop - len) AS a, max(stop) AS b,
                      sha256(min(stop - len) || ':' || max(stop) || ':' || string_agg(h, ',' ORDER BY seq)) AS h FROM m GROUP BY f, seq // 10),
        l2 AS (SELECT f, seq // 10 AS seq, min(a) AS a, max(b) AS b,
                      sha256(min(a) || ':' || max(b) || ':' || string_agg(h, ',' ORDER BY seq)) AS h FROM l1 GROUP BY f, seq // 10),
        l3 AS (SELECT f, sha256(min(a) || ':' || max(b) || ':' || string_agg(h, ',' ORDER BY seq)) AS h FROM l2 GROUP BY f)
        SELECT page_id, m.f AS warc_file, m.seq, stop - len AS rec_start, stop AS rec_stop, m.h AS record_sha256,
               l3.h AS file_root, intact
        FROM m JOIN l3 ON l3.f = m.f""",
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                          ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''),
                         lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                         lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM t),
        s AS (SELECT h.c, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:]) AS seq
              FROM h LEFT JOIN t b ON b.c = h.c - h.c % 20),
        m AS (SELECT c, len(seq) AS n, unnest(range(len(seq) + 1)) AS d, seq FROM s),
        k AS (SELECT c, n, d, seq[1:d] AS p, CASE WHEN d > 0 THEN len(regexp_extract_all(seq[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM m),
        nodes AS (SELECT p, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(w) AS w,
                         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256 FROM k GROUP BY p),
        kids AS (SELECT p[1:len(p) - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        up AS (SELECT p[1:a] AS p, leaf, own FROM (
                 SELECT nodes.p, (kids.p IS NULL)::INT AS leaf, (n_convs - 1) * w AS own, unnest(range(len(nodes.p) + 1)) AS a
                 FROM nodes LEFT JOIN kids ON kids.p = nodes.p)),
        sums AS (SELECT p, sum(leaf)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM up GROUP BY p)
        SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, nodes.n_convs,
               coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
        FROM nodes JOIN sums ON sums.p = nodes.p LEFT JOIN kids ON kids.p = nodes.p
        LEFT JOIN nodes o ON nodes.depth > 0 AND o.p = nodes.p[1:len(nodes.p) - 1]""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
        f AS (SELECT d.*, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                     100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS e1,
                     doc_id > min(doc_id) OVER (PARTITION BY t) AS e2, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad
              FROM d LEFT JOIN l USING (doc_id)),
        x AS (SELECT part, good, bad, a::INT + 2 * b::INT + 4 * c::INT + 8 * e1::INT + 16 * coalesce(e2, false)::INT AS mask, count(*) AS n
              FROM f GROUP BY ALL),
        v AS (SELECT part, s, sum(n) FILTER (mask & s > 0) AS gone, sum(n) AS n, sum(n) FILTER (mask & s > 0 AND good = 1) AS good,
                     sum(n) FILTER (mask & s > 0 AND bad = 1) AS bad FROM x, range(32) r(s) GROUP BY part, s),
        g AS (SELECT part, s, coalesce(gone, 0) AS gone, n, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM v),
        i AS (SELECT unnest(range(5)) AS i),
        o AS (SELECT [p.i, q.i, r.i, s.i, t.i] AS o FROM i p, i q, i r, i s, i t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
        st AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
        sb AS (SELECT list_aggregate(list_transform(o, lambda y: substr('ABCDE', y::INT + 1, 1)), 'string_agg', '') AS filter_order, step, o[step] AS i,
                      coalesce(list_sum(list_transform(o[1:step - 1], lambda y: (1 << y))), 0)::BIGINT AS before FROM st),
        r AS (SELECT z.part, filter_order, step, i, z.n - z.gone AS kept, z.gone - y.gone AS removed, one.gone - z.gone + y.gone AS redundant,
                     everyone.gone - rest.gone AS unique_fails, z.good - y.good AS good_lost, z.bad - y.bad AS toxic_lost
              FROM sb JOIN g y ON y.s = before JOIN g z ON z.part = y.part AND z.s = before + (1 << i)
              JOIN g one ON one.part = y.part AND one.s = (1 << i) JOIN g everyone ON everyone.part = y.part AND everyone.s = 31
              JOIN g rest ON rest.part = y.part AND rest.s = 31 - (1 << i))
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM r""",
}
