"""The registered queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwellstat.llm import (alignment, decontamination, html_extraction, language_id, line_dedup, mixing, near_dedup, near_vectors, quality_rules,
                           suffix_dedup, toxicity, vector_codes, warc)
from dwellstat.llm.common import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


_QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS k
    FROM w WHERE len(w) >= 8),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, range(0, 8) AS r(o) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.rid, d.doc_id, d.lang, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines
      FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT rid, doc_id, lang, source, base_failed, unnest([1, 2, 3, 4]) AS measure,
        unnest([word_chars * 100 // greatest(n_words, 1), n_symbols * 1000 // greatest(n_words, 1),
                n_dup_lines * 1000 // greatest(n_lines, 1), n_repeat_words * 1000 // greatest(n_words, 1)]) AS val FROM b),
k AS (SELECT *, val - val % (1 << greatest(length(bin(val)) - 6, 0)) AS bucket FROM v),
c AS (SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source, measure, bucket, count(*) AS n
      FROM k, (VALUES (0), (1), (2)) AS x(level) WHERE NOT base_failed GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, measure) AS n_docs FROM c),
q AS (SELECT level, lang, source, measure, max(n_docs) AS n_docs, min(bucket) FILTER (WHERE 4 * upto >= n_docs) AS q1,
        min(bucket) FILTER (WHERE 4 * upto >= 3 * n_docs) AS q3 FROM r GROUP BY ALL),
one AS (SELECT c.level, c.lang, c.source, c.measure, c.bucket, unnest(range(c.n)), q.q1, q.q3 FROM c JOIN q ON c.level = q.level AND c.measure = q.measure
      AND c.lang IS NOT DISTINCT FROM q.lang AND c.source IS NOT DISTINCT FROM q.source),
mid AS (SELECT level, lang, source, measure, quantile_disc(bucket, 0.5) FILTER (bucket > q3) AS hi, -quantile_disc(-bucket, 0.5) FILTER (bucket < q1) AS lo FROM one GROUP BY ALL),
f AS (SELECT q.*, least(q1 - 3 * (q3 - q1), q1 - q1 // 8, lo + 1) AS low, greatest(q3 + 3 * (q3 - q1), q3 + q3 // 8, hi - 1) AS high
      FROM q JOIN mid ON mid.level = q.level AND mid.measure = q.measure AND mid.lang IS NOT DISTINCT FROM q.lang AND mid.source IS NOT DISTINCT FROM q.source),
j AS (SELECT k.rid, k.measure, k.val, f.level, f.low, f.high FROM k
      JOIN f ON k.measure = f.measure AND f.lang IS NOT DISTINCT FROM CASE WHEN f.level < 2 THEN k.lang END
        AND f.source IS NOT DISTINCT FROM CASE WHEN f.level < 1 THEN k.source END
      WHERE f.n_docs >= 50 OR f.level = 2
      QUALIFY row_number() OVER (PARTITION BY k.rid, k.measure ORDER BY f.level) = 1),
o AS (SELECT rid, bool_and(val <= high AND (measure <> 1 OR val >= low)) AS inside FROM j GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(inside, true) AS kept
FROM b LEFT JOIN o USING (rid)
"""


@query("op6_quality_rules", _QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document under thresholds of its language and source."""
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix by weight takes, with the shards its copies go to."""
    return mixing.shares(table(spark, sf_dir, "documents"))


_LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t, row_number() OVER () AS rid FROM documents),
l AS (SELECT rid, doc_id, unnest(t) AS line, unnest(range(len(t))) AS i FROM d),
f AS (SELECT *, lag(line) OVER w AS before, lag(i) OVER w AS before_i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY rid ORDER BY i)),
u AS (SELECT rid, doc_id, before_i AS b, i AS e, before || chr(10) || line AS x FROM f WHERE before IS NOT NULL
    UNION ALL SELECT rid, doc_id, i, i, line FROM f WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50),
g AS (SELECT rid, b, e FROM u QUALIFY (doc_id, b) <> first_value((doc_id, b)) OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, b)),
r AS (SELECT DISTINCT rid, unnest(range(b, e + 1)) AS i FROM g),
n AS (SELECT rid, count(*) AS n, count(*) FILTER (fresh) AS runs FROM (SELECT rid, i, coalesce(i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 1, true) AS fresh FROM r) GROUP BY rid),
k AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY l.i) AS kept FROM l LEFT JOIN r ON l.rid = r.rid AND l.i = r.i WHERE r.i IS NULL GROUP BY l.rid)
SELECT doc_id, len(t)::BIGINT AS n_lines, coalesce(n, 0) AS n_removed_lines, coalesce(runs, 0) AS n_removed_runs, md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""


@query("op10_line_dedup", _LINES_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document as repeats of earlier passages."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


_LEAKS_SQL = r"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
    UNION ALL SELECT 'i', item_id, row_number() OVER (), regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, rid, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) >= 5),
n AS (SELECT id, rid, count(*) AS n FROM s WHERE kind = 'i' GROUP BY ALL),
f AS (SELECT d.id AS doc_id, d.rid AS drid, i.id AS item_id, i.rid AS irid, count(*) AS f FROM s d JOIN s i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, max(n) AS n_shingles, max(f) AS n_found, max(f / n) AS containment
FROM f JOIN n ON f.item_id = n.id AND f.irid = n.rid WHERE f >= 0.8 * n GROUP BY doc_id, item_id
"""


@query("op5_decontamination", _LEAKS_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item found inside it."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
w AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM d),
r AS (SELECT rid, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) >= 5),
s AS (SELECT rid, s, count(*) AS c FROM r GROUP BY ALL),
t AS (SELECT rid, sum(c) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, sum(least(a.c, b.c)) AS i FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN t x ON x.rid = a JOIN t y ON y.rid = b WHERE i >= 0.8 * (x.n + y.n - i)
    UNION SELECT rid, min(rid) OVER (PARTITION BY text) FROM d WHERE text IS NOT NULL),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS rid, min(b) AS root FROM reach GROUP BY a)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size,
  doc_id = min(doc_id) OVER (PARTITION BY root) AS stays FROM d JOIN c USING (rid)
"""


@query("op3_near_dedup", _NEAR_SQL)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "stays")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of the label categories for every document, and the verdict on it."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LANGUAGE_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, text, string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c,
    doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
        lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 3 = 1 AS held_out FROM documents, tab),
u AS (SELECT rid, list_transform(c, lambda x: unicode(x)::BIGINT) AS u FROM d WHERE len(c) > 2),
g AS (SELECT rid, unnest(u) AS v FROM u
    UNION ALL SELECT rid, unnest(list_transform(range(1, len(u)), lambda i: (u[i] << 21) | u[i + 1])) FROM u
    UNION ALL SELECT rid, unnest(list_transform(range(1, len(u) - 1), lambda i: (u[i] << 42) | (u[i + 1] << 21) | u[i + 2])) FROM u),
n AS (SELECT rid, v, count(*) AS n FROM g WHERE v <> 32 GROUP BY ALL),
p AS (SELECT rid, v, row_number() OVER (PARTITION BY rid ORDER BY n DESC, v) - 1 AS r FROM n QUALIFY r < 400),
l AS (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, v) - 1 AS r FROM n JOIN d USING (rid)
    WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL GROUP BY lang, v QUALIFY r < 400),
far AS (SELECT p.rid, names.lang, sum(coalesce(abs(l.r - p.r), 400)) AS far, count(*) AS size FROM p CROSS JOIN (SELECT DISTINCT lang FROM l) names
    LEFT JOIN l ON l.lang = names.lang AND l.v = p.v GROUP BY ALL),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY rid ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - far::DOUBLE / (400 * size), 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (rid)
"""


@query("op2_language_id", _LANGUAGE_SQL)
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identified(table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""


@query("op4_warc", _WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from archives through their index."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("html")


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


_SUFFIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, doc_id, unnest(range(0, length(h) // 2 - 49)) AS i,
    unnest(list_transform(range(0, length(h) // 2 - 49), lambda i: md5_number_lower(substring(h, 2 * i + 1, 100)))) AS s FROM d),
m AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING count(*) > 1),
c AS (SELECT rid, i FROM p JOIN m USING (s) WHERE doc_id > least OR (doc_id IS NULL AND least IS NOT NULL)),
g AS (SELECT rid, i, coalesce(i > lag(i) OVER w + 50, true) AS fresh FROM c WINDOW w AS (PARTITION BY rid ORDER BY i)),
k AS (SELECT rid, i, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY i) AS k FROM g),
r AS (SELECT rid, k, min(i) AS b, max(i) + 50 AS e FROM k GROUP BY ALL),
x AS (SELECT rid, b, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS since FROM r),
y AS (SELECT d.rid, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substring(h, 2 * since + 1, 2 * (b - since)), '' ORDER BY b) AS kept
    FROM x JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, (length(h) // 2) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN y USING (rid)
"""


@query("op9_suffix_dedup", _SUFFIX_SQL)
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat an earlier document, and the digest of the rest."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Plain Lloyd rounds in whole numbers: every part against every entry each time."""
    steps = [f"""
v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rid, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) AS r(p)),
c0 AS (SELECT p, rid - 1 AS e, x AS c FROM x WHERE rid <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT rid, p, x, e, d FROM (SELECT rid, x.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
    FROM x JOIN c{r} USING (p)) QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(x)) FROM x) + 1) AS q(i) GROUP BY ALL),
m{r} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY ALL),
c{r + 1} AS (SELECT p, e, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (p, e))""")
    return f"""WITH {",".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
o AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (rid), h"""


@query("op11_vector_codes", _codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-byte code of every usable vector, with its error and the digest of the codebooks."""
    return vector_codes.encoded(table(spark, sf_dir, "embeddings"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers for every document, with corpus-wide pair counts."""
    return alignment.aligned(table(spark, sf_dir, "documents"))


_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT rid, vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.rid AS a, y.rid AS b FROM g x JOIN g y ON x.rid <> y.rid AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
n AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a AS rid, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = b GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


@query("op13_near_vectors", _VECTORS_SQL)
def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors.linked(table(spark, sf_dir, "embeddings"))
