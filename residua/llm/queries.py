"""One thin query per operator over its whole table, with the SQL it must equal where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from residua.llm import alignment, bpe, fingerprints, lines, minhash, packing, pii, quality, subwords, suffixes, toxicity, vector_codes, warc
from residua.llm.registry import query, table
from residua.operators.storage import scratch_directory


def _fingerprint_sql() -> str:
    n = fingerprints.SHORT
    return f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
nx AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM o WINDOW w AS (ORDER BY doc_id NULLS FIRST, t)),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS e FROM nx),
x AS (SELECT DISTINCT x FROM (SELECT t AS x FROM e UNION ALL SELECT e FROM e)),
ps AS (SELECT x, sha256(x) AS k, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS ps FROM x),
p AS (SELECT k, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM ps),
c AS (SELECT *, sum(CASE WHEN i > 1 AND regexp_full_match(p, '[ \t]*\n') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS s,
      list_transform(regexp_extract_all(p, '{fingerprints.CLAUSE}'), lambda v: sha256(v)) AS cs FROM p),
sec AS (SELECT k, s, sha256('S' || string_agg(sha256('P' || array_to_string(cs, '')), '' ORDER BY i)) AS node,
        string_agg(array_to_string(list_transform(cs, lambda v: substr(v, 1, {n})), ''), '.' ORDER BY i) AS body,
        flatten(list(list_transform(cs, lambda v: substr(v, 1, {n})))) AS leaves FROM c GROUP BY k, s),
doc AS (SELECT k, sha256('R' || string_agg(node, '' ORDER BY s)) || ':' || string_agg(body, '/' ORDER BY s) AS f, list_distinct(flatten(list(leaves))) AS l
        FROM sec GROUP BY k),
f AS (SELECT k, coalesce(f, sha256('R') || ':') AS f, coalesce(l, []) AS l FROM ps LEFT JOIN doc USING (k)),
j AS (SELECT e.doc_id, length(t) AS n, sha256(e) AS es, a.f AS fa, a.l AS la, b.f AS fb, b.l AS lb, c.f AS fc, c.l AS lc
      FROM e JOIN f a ON a.k = sha256(t) JOIN f b ON b.k = sha256(e) JOIN f c ON c.k = sha256(nx))
SELECT doc_id, n::BIGINT AS n_chars, es AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  CASE WHEN substr(fa, 1, 64) = substr(fb, 1, 64) THEN 1.0::DOUBLE
       ELSE least(2 * len(list_intersect(la, lb)) / greatest(len(la) + len(lb), 1), 0.999::DOUBLE) END AS near_edited,
  CASE WHEN substr(fa, 1, 64) = substr(fc, 1, 64) THEN 1.0::DOUBLE
       ELSE least(2 * len(list_intersect(la, lc)) / greatest(len(la) + len(lc), 1), 0.999::DOUBLE) END AS near_next
FROM j
"""


def _quality_sql() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    chain, left, previous = [], ["length(t)"], "t"
    for i, pattern in enumerate(quality.CLASSES.values()):
        chain.append(f"r{i} AS (SELECT *, regexp_replace({previous}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS c{i} FROM {'s' if i == 0 else f'r{i - 1}'})")
        previous = f"c{i}"
        left.append(f"length(c{i})")
    n = len(quality.CLASSES)
    counts = ", ".join([f"{a} - {b}" for a, b in zip(left, left[1:])] + [left[-1]])
    hits = ", ".join(f"(length(sp) - length(replace(sp, '|{w}|', ''))) // {len(w) + 2}" for w in quality.WORDS)

    def apart(name: str) -> str:
        p, q = f"x[1] / list_sum({name})", f"x[2] / list_sum(ref_{name})"
        term = f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0.0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0.0 END"
        return f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({name}, ref_{name}), lambda x: ({term}) / 2))))"

    def summed(name: str, bins: int) -> str:
        return "[" + ", ".join(f"sum({name}[{i + 1}])::BIGINT" for i in range(bins)) + f"] AS ref_{name}"

    keys = ", ".join(f"'{k}'" for k in quality.COMMON_WORDS)
    (cb, cn), (wb, wn) = quality.CHAR_LIMIT, quality.WORD_LIMIT
    return f"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({keys}) THEN lang ELSE 'other' END AS k FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM s),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
{", ".join(chain)},
h AS (SELECT doc_id, k, t, [{counts}] AS chars, '|' || regexp_replace(lower(t), '\\P{{L}}+', '||', 'g') || '|' AS sp,
      list_filter(string_split(t, chr(10)), lambda l: length(translate(l, {blanks}, '')) > 0) AS ls FROM r{n - 1}),
b AS (SELECT *, [{hits}] AS hits, len(list_filter(regexp_split_to_array(sp, '\\|+'), lambda x: x <> '')) AS n_letter FROM h),
f AS (SELECT *, list_append(hits, (n_letter - list_sum(hits))::BIGINT) AS bins FROM b),
ref AS (SELECT k, {summed("chars", n + 1)}, {summed("bins", len(quality.WORDS) + 1)} FROM f GROUP BY k),
j AS (SELECT f.doc_id, len(w.w)::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars,
      (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, n_letter, list_sum(chars) AS n_chars,
      CASE WHEN list_sum(chars) >= {quality.MIN_CHARS} THEN round({apart("chars")}, 6) END AS char_distance,
      CASE WHEN n_letter >= {quality.MIN_LETTER_WORDS} THEN round({apart("bins")}, 6) END AS word_distance
      FROM f JOIN w USING (doc_id) JOIN ref USING (k) LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(char_distance > {cb} + {cn} / sqrt(n_chars), false)
    AND NOT coalesce(word_distance > {wb} + {wn} / sqrt(n_letter), false) AS kept, char_distance, word_distance FROM v
"""


@query(_fingerprint_sql())
def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


#: Production keys come from the caller; this one only makes the query repeatable.
PII_KEY = "repeatable query"


@query()
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


@query()
def op3_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"), remembered=1_200_000)


NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id
"""


@query()
def op4_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(NEAR_SQL)
def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


LINES_SQL = f"""
WITH l AS (SELECT doc_id, i - 1 AS line_no, list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '') AS w
           FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents))),
k AS (SELECT doc_id, line_no, len(w) AS n, w, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= {lines.LEAST_WORDS}),
c AS (SELECT s, n, any_value(w) AS w, min((doc_id, line_no)) AS f FROM k GROUP BY s, n),
v AS (SELECT s, n, f, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c)),
near AS (SELECT b.s, min(a.f) AS g FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.n = b.n AND a.f < b.f GROUP BY b.s
         UNION ALL SELECT v.s, min(c.f) FROM v JOIN c ON v.v = c.s WHERE c.f < v.f GROUP BY v.s
         UNION ALL SELECT c.s, min(v.f) FROM v JOIN c ON v.v = c.s WHERE v.f < c.f GROUP BY c.s),
m AS (SELECT s, min(g) AS g FROM near GROUP BY s),
j AS (SELECT k.doc_id, k.line_no, coalesce(m.g, c.f) AS f, CASE WHEN m.g IS NULL THEN 0 ELSE 1 END AS edits
      FROM k JOIN c USING (s) LEFT JOIN m USING (s))
SELECT doc_id, line_no::BIGINT AS line_no, f[1]::BIGINT AS keeper_doc_id, f[2]::BIGINT AS keeper_line_no, edits::BIGINT AS edits
FROM j WHERE (doc_id, line_no) <> f
"""


@query(LINES_SQL)
def op6_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(table(spark, sf_dir, "documents"))


@query(_quality_sql())
def op7_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


REPEATS_SQL = f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * suffixes.WIDTH})) AS m
      FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {suffixes.WIDTH - 1})) AS i FROM b WHERE length(h) >= {2 * suffixes.WIDTH})),
again AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {suffixes.WIDTH} THEN 0 ELSE 1 END AS new FROM s SEMI JOIN again USING (m)),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
spans AS (SELECT r, run, min(i) AS a, max(i) + {suffixes.WIDTH} AS z FROM k GROUP BY r, run),
pieces AS (SELECT r, 0 AS f, min(a) AS t FROM spans GROUP BY r
           UNION ALL SELECT r, z, lead(a) OVER (PARTITION BY r ORDER BY a) FROM spans),
kept AS (SELECT r, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, length(h) // 2) - f)), '' ORDER BY f) AS kept FROM pieces JOIN b USING (r) GROUP BY r),
n AS (SELECT r, count(*) AS spans, sum(z - a) AS gone FROM spans GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""


@query(REPEATS_SQL)
def op8_deep_shallow_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


WARC_SQL = f"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: '{warc.BASE32_DIGITS}'[
        1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)]), '') AS d,
      first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM r)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to,
  (length('WARC/1.1  WARC-Type: ') + length(CASE WHEN again THEN 'revisit' ELSE 'response' END) + 2
   + length('WARC-Record-ID: <urn:page:>') + length(coalesce(page_id::VARCHAR, '')) + 2 + length('WARC-Target-URI: ') + octet_length(encode(url)) + 2
   + CASE WHEN again THEN length('WARC-Refers-To: <urn:page:>') + length(first::VARCHAR) + 2 ELSE 0 END
   + length('WARC-Payload-Digest: sha1:') + 32 + 2 + length('Content-Type: application/http; msgtype=response') + 2 + length('Content-Length: ')
   + length((http + CASE WHEN again THEN 0 ELSE n END)::VARCHAR) + 4 + http + CASE WHEN again THEN 0 ELSE n END + 4)::BIGINT AS record_bytes
FROM (SELECT *, {sum(len(x) + 2 for x in warc.HTTP_LINES)} + length('Content-Length: ') + length(n::VARCHAR) + 4 AS http FROM b)
"""


@query(WARC_SQL)
def op9_content_addressed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_directory(spark).rstrip('/')}/archive-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.archive_report(warc.read_archive(spark, path))


@query()
def op10_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op11_arrow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), path_a, path_b)


@query()
def op12_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _codes_sql() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM k, range({parts}) AS t(part))",
        f"c0 AS (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries})",
    ]
    for n in range(vector_codes.ROUNDS + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, part, min((d, entry)) AS best FROM (SELECT r, part, entry, {distance} AS d FROM p JOIN c{n} AS c USING (part)) GROUP BY r, part)"
        )
        if n < vector_codes.ROUNDS:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN (
  SELECT part, entry, list((s - ((s % n + n) % n)) // n ORDER BY i) AS v FROM (
    SELECT part, best[2] AS entry, i, sum(p.v[i])::BIGINT AS s, count(*) AS n FROM a{n} JOIN p USING (r, part), range(1, (SELECT max(len(v)) FROM p) + 1) AS t(i) GROUP BY 1, 2, 3)
  GROUP BY part, entry) AS m USING (part, entry))""")
    last = vector_codes.ROUNDS
    return f"""WITH {', '.join(steps)},
e AS (SELECT r, string_agg(printf('%02x', best[2]::INT), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{last} GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM c{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN k USING (r), b
"""


@query(_codes_sql())
def op13_drake_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(vector_codes.compress(table(spark, sf_dir, "embeddings")))
