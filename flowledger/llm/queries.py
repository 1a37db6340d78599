"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    rows = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    return tokens.length_histogram(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_ids=1)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    done = suffix.remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept_bytes")).alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.round_trip_digests(common.table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(common.id_remainder("doc_id", 3) != 1))
    return langid.predict(docs, model).withColumn("held_out", common.id_remainder("doc_id", 3) == 1)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    return lines.drop_boilerplate(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import metric

    return metric.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.jaccard_components(common.table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    pieces = packing.pack(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    docs = common.table(spark, sf_dir, "documents").withColumn("held_out", common.id_remainder("doc_id", 5) == 1)
    model = lm.fit(docs.where(~F.col("held_out")))
    scored = common.checkpoint(lm.score(docs, model).withColumn("held_out", common.id_remainder("doc_id", 5) == 1))
    lm.delete(model)
    return scored


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ranked

    return ranked.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dialogue

    return dialogue.repair(common.table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_top_k, op2_token_counts, op3_language_id, op4_line_dedup, op5_embedding_dedup, op6_ngram_jaccard, op7_packing, op8_suffix_dedup, op9_sentencepiece, op10_lm_scoring, op11_ranked_search, op12_conversation_repair, op13_quality_rules)}


OP1_SQL = """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * r.v[i])) AS BIGINT) AS score
      FROM d q JOIN d r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP4_SQL = """
WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT source, line, count(*) AS pages FROM l WHERE trim(line) <> '' GROUP BY source, line),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT n.source, list(line) AS listed FROM n JOIN t USING (source) WHERE pages >= 2 AND pages > total * 0.05 GROUP BY n.source),
k AS (SELECT doc_id, text, coalesce(listed, []) AS listed, string_split(text, chr(10)) AS lines FROM documents LEFT JOIN b USING (source))
SELECT doc_id, array_to_string(list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(listed, x)), chr(10)) AS text,
       CAST(len(list_filter(lines, lambda x: trim(x) <> '' AND list_contains(listed, x))) AS BIGINT) AS lines_dropped FROM k
"""


OP5_SQL = """
WITH RECURSIVE d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM d WHERE list_dot_product(v, v) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) >= 0.93 * a.n * b.n),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, e.y FROM r JOIN e ON r.m = e.x),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
l AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT c.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN l ON l.x = c.vec_id
"""

OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
      ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


#: Windows of 100 bytes; all but the earliest of equal ones go, and runs of them are joined.
OP8_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + 100] AS s FROM (SELECT doc_id, encode(coalesce(text, '')) AS b, unnest(range(0, strlen(coalesce(text, '')) - 99)) AS i FROM documents)),
r AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
n AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM r),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
p AS MATERIALIZED (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run)),
k AS (SELECT p.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * last + 1)) AS kept, sum(b - a) AS removed, count(*) AS spans
      FROM p JOIN d ON d.doc_id = p.doc_id JOIN (SELECT doc_id, max(b) AS last FROM p GROUP BY doc_id) l ON l.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


OP11_SQL = """
WITH term AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term GROUP BY doc_id, t), n AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
g AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM n), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
s AS (SELECT q.item_id, tf.doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * g.N + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n.n * g.N) // g.L)))) AS BIGINT) AS score
      FROM q JOIN tf USING (t) JOIN df USING (t) JOIN n ON n.doc_id = tf.doc_id CROSS JOIN g GROUP BY q.item_id, tf.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def _repair_step(q: int, after: int, role: str, kept: dict[str, int]) -> str:
    """Cheapest (cost, audit, lines) from state ``q`` before a row, without inserts before it."""
    edit = lambda cost, letter, to, line: f"CASE WHEN {cost[0]} THEN [{{'c': s{to}.c + {cost[1]}, 'a': '{letter}' || s{to}.a, 'l': {line}s{to}.l}}] ELSE [] END"
    own = "[role || ':' || text] || "
    options = [edit(("TRUE", "2"), "D", q, ""), edit(("NOT gone", "1 + 5 * cut"), "R", after, f"['{role}:' || text] || ")]
    options += [edit((f"NOT gone AND left(role, 1) = '{i}'", "5 * cut"), "K", to, own) for i, to in kept.items()]
    return f"list_min({' || '.join(options)})"


_INSERTED = lambda q, to, role: f"list_min([b{q}, {{'c': b{to}.c + 5, 'a': 'I' || b{to}.a, 'l': ['{role}:'] || b{to}.l}}])"
_CRC = "list_reduce(list_prepend({0}, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))"
_NONE = "{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}"
_ONE, _TWO = "{'c': 5, 'a': 'I', 'l': ['assistant:']}", "{'c': 10, 'a': 'II', 'l': ['user:', 'assistant:']}"

#: A recursion over each conversation's rows from the last: the cheapest cost, then the least audit, then its lines, from each of four states.
OP12_SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list({_CRC.format("CAST(n AS BIGINT)")} ORDER BY n) AS t FROM range(256) r(n)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS f FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE f <> 0),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
m AS MATERIALIZED (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT blank AND nth > 1 AS dup, blank OR dup AS gone, CAST(NOT gone AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS INTEGER) AS cut FROM o),
r AS (SELECT conv_id, max(i) AS i, {_NONE} AS s0, {_TWO} AS s1, {_ONE} AS s2, {_NONE} AS s3 FROM m GROUP BY conv_id
UNION ALL SELECT conv_id, i, {_INSERTED(0, 2, "user")}, {_INSERTED(1, 2, "user")}, {_INSERTED(2, 3, "assistant")}, {_INSERTED(3, 2, "user")} FROM (
  SELECT r.conv_id, r.i - 1 AS i, {_repair_step(0, 2, "user", {"s": 1, "u": 2})} AS b0, {_repair_step(1, 2, "user", {"u": 2})} AS b1, {_repair_step(2, 3, "assistant", {"a": 3})} AS b2, {_repair_step(3, 2, "user", {"u": 2})} AS b3
  FROM r JOIN m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, sum(cut) AS truncated,
      count_if(i > 1 AND (left(last, 1) || left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_suffix_dedup": OP8_SQL, "op1_top_k": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_embedding_dedup": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op11_ranked_search": OP11_SQL, "op12_conversation_repair": OP12_SQL}
