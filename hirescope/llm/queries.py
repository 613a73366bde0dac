"""The registered queries of this subpackage and their DuckDB statements.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's real output.
"""

import public_tokenizers
from pyspark.sql import functions as F

from hirescope.llm import (
    bpe,
    fill_middle,
    host_lines,
    lines,
    minhash,
    mixing,
    pii,
    quality,
    token_counts,
    topk,
    toxicity,
    vector_codes,
    vector_dedup,
)
from hirescope.llm.common import stored, table


def op4_byte_bpe(spark, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark, sf_dir):
    tokenizer = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer, public_tokenizers.PATTERN)


def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


# Words are lower-cased in A-Z only, so the statement translates those letters.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP9_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ 	-
]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM both_in JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
"""


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


# A key for the registered query; a real run passes its own secret.
PSEUDONYM_KEY = "registered-query"


def op6_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of_kind = lambda name: F.filter("_found", lambda p: p["kind"] == name)
    counts = [F.size(of_kind(name)).alias(f"n_{name}") for name in pii.KINDS]
    return pii.pseudonymised(docs, PSEUDONYM_KEY).select("doc_id", "text", *counts)


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_recurring_lines(docs).withColumnsRenamed({"_n_lines": "n_lines", "_n_dropped": "n_dropped"})


# RE2 knows no possessive repeats; it needs none, as it never tracks back.
OP7_SQL = rf"""
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (
  SELECT DISTINCT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM cut),
lines AS (
  SELECT doc_id, line_no,
    string_split(trim(regexp_replace(regexp_replace(line, '[^ \t\r\f\x0B]*[0-9@][^ \t\r\f\x0B]*', '<*>', 'g'),
      '[ \t\r\f\x0B]+', ' ', 'g'), ' '), ' ') AS w FROM raw),
nodes AS (
  SELECT doc_id, line_no, w, len(w) AS n, w[:{lines.LEAD_TOKENS}] AS lead FROM lines WHERE len(w) >= {lines.MIN_TOKENS}),
variants AS (
  SELECT DISTINCT w, n, lead FROM nodes WHERE n >= {lines.VARIABLE_TOKENS}),
totals AS (
  SELECT n, lead, count(*) AS variants FROM variants GROUP BY ALL),
tokens AS (
  SELECT w, n, lead, unnest(w[{lines.LEAD_TOKENS + 1}:]) AS token, unnest(range({lines.LEAD_TOKENS}, n)) AS place FROM variants),
held AS (
  SELECT n, lead, place, token, count(*) AS c FROM tokens GROUP BY ALL),
patterns AS (
  SELECT w, n, lead,
    list(CASE WHEN c > 1 AND 2 * c >= variants THEN [token] ELSE [] END ORDER BY place) AS often,
    list(CASE WHEN c > 1 THEN [token] ELSE [] END ORDER BY place) AS every
  FROM tokens JOIN held USING (n, lead, place, token) JOIN totals USING (n, lead) GROUP BY ALL),
chosen AS (
  SELECT w, CASE
    WHEN 100 * ({lines.LEAD_TOKENS} + len(flatten(often))) >= {lines.CONSTANT_PERCENT} * n THEN lead::VARCHAR || 'often' || often::VARCHAR
    WHEN 100 * ({lines.LEAD_TOKENS} + len(flatten(every))) >= {lines.CONSTANT_PERCENT} * n THEN lead::VARCHAR || 'every' || every::VARCHAR
    END AS leaf
  FROM patterns),
placed AS (
  SELECT doc_id, line_no, n, coalesce(leaf, w::VARCHAR) AS leaf FROM nodes LEFT JOIN chosen USING (w)),
recurring AS (
  SELECT leaf, min(doc_id) AS keeper FROM placed GROUP BY leaf
  HAVING count(DISTINCT doc_id) >= CASE WHEN max(n) >= {lines.LONG_TOKENS}
    THEN {lines.LONG_DOCS} ELSE {lines.SHORT_DOCS} END),
dropped AS (
  SELECT doc_id, list(DISTINCT line_no) AS gone FROM placed JOIN recurring USING (leaf)
  WHERE doc_id <> keeper GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10))
  END AS text,
  coalesce(len(ls), 0)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_dropped
FROM cut LEFT JOIN dropped USING (doc_id)
"""


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "source", F.col("_slot").alias("slot"), F.col("_place").alias("place"),
                                     F.col("_on_target").alias("on_target"))


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "n_hits", "n_misspelt")


def op2_vector_dedup(spark, sf_dir):
    links, unit = vector_dedup.linked(table(spark, sf_dir, "embeddings"))
    links = stored(links, "vector-dedup")
    if unit is not None:
        vector_dedup.audit(links, unit)
    return links


OP2_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x),
least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted ON x = vec_id
"""


def op3_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
WHERE rank <= 20
"""


def op11_host_lines(spark, sf_dir):
    return host_lines.figures(table(spark, sf_dir, "documents")).drop("host")


OP11_SQL = rf"""
WITH given AS (SELECT DISTINCT doc_id, source, text FROM documents),
t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM given),
raw_lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (
  SELECT doc_id, host, text, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw_lines
  WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY ALL),
windows AS (
  SELECT doc_id, host, text, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
    lambda k: array_to_string(w[k:k + 2], ' '))) AS win FROM t WHERE len(w) >= 3),
repeated AS (
  SELECT doc_id, host, text, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, host, text, win) > 1),
covered AS (
  SELECT doc_id, host, text, count(DISTINCT i + k) AS n_repeat_words
  FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL),
norm AS (
  SELECT doc_id, host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'),
    '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS line FROM raw_lines),
worded AS (SELECT *, len(string_split(line, ' ')) AS words FROM norm WHERE line <> ''),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM worded GROUP BY host),
frequent AS (
  SELECT host, line FROM worded JOIN hosts USING (host) GROUP BY host, line, host_docs
  HAVING count(DISTINCT doc_id) > {host_lines.LINE_DOCS}
    AND 100 * count(DISTINCT doc_id) > {host_lines.LINE_PERCENT} * host_docs),
gone AS (
  SELECT doc_id, host, text, count(*) AS n_lines_removed, sum(words)::BIGINT AS n_words_removed
  FROM worded JOIN frequent USING (host, line) GROUP BY ALL),
figures AS (
  SELECT doc_id, host, text, len(w)::BIGINT AS n_words,
    length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w) < {host_lines.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {host_lines.REPEAT_PERCENT} * len(w) AS base_failed,
    coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed
  FROM t LEFT JOIN dup USING (doc_id, host, text) LEFT JOIN covered USING (doc_id, host, text)
    LEFT JOIN gone USING (doc_id, host, text))
SELECT f.* EXCLUDE (host, text),
  NOT base_failed AND 100 * (n_words - n_words_removed) >= {host_lines.LEFT_PERCENT} * n_words AS kept
FROM documents d JOIN figures f
  ON d.doc_id = f.doc_id AND coalesce(d.source, '') = f.host AND coalesce(d.text, '') = f.text
"""


def op12_fill_middle(spark, sf_dir):
    return fill_middle.digests(fill_middle.assembled(table(spark, sf_dir, "documents")))


OP12_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
    array_to_string(u[b + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""


def op13_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded).select(
        "vec_id", F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
        "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _op13_sql(parts: int = vector_codes.PARTS, rounds: int = vector_codes.ROUNDS) -> str:
    """One pair of tables (assignment, codebook) a round."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, label, p, e[p * (len(e) // {parts}) + 1:(p + 1) * (len(e) // {parts})] AS c
  FROM v, (SELECT unnest(range({parts})) AS p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT {vector_codes.ENTRIES}),
b0 AS MATERIALIZED (SELECT p, k, c FROM x JOIN firsts USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, c, min_by(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT x.vec_id, x.label, x.p, x.c, b.k,
      list_sum(list_transform(list_zip(x.c, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
    FROM x JOIN b{r} b ON x.p = b.p) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (
  SELECT p, k, j, sum(y) AS total, count(*) AS n FROM (
    SELECT p, k, unnest(range(len(c))) AS j, unnest(c) AS y FROM a{r}) GROUP BY p, k, j),
m{r} AS (SELECT p, k, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{r} GROUP BY p, k),
b{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, k))""")
    return f"""
WITH {','.join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY ALL),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book
"""


OP13_SQL = _op13_sql()


def queries():
    return {
        "op2_vector_dedup": op2_vector_dedup,
        "op3_topk": op3_topk,
        "op1_toxicity": op1_toxicity,
        "op10_mixing": op10_mixing,
        "op5_quality": op5_quality,
        "op6_pii": op6_pii,
        "op7_line_dedup": op7_line_dedup,
        "op9_minhash": op9_minhash,
        "op4_byte_bpe": op4_byte_bpe,
        "op8_token_counts": op8_token_counts,
        "op11_host_lines": op11_host_lines,
        "op12_fill_middle": op12_fill_middle,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql():
    return {
        "op2_vector_dedup": OP2_SQL,
        "op3_topk": OP3_SQL,
        "op7_line_dedup": OP7_SQL,
        "op9_minhash": OP9_SQL,
        "op11_host_lines": OP11_SQL,
        "op12_fill_middle": OP12_SQL,
        "op13_vector_codes": OP13_SQL,
    }
