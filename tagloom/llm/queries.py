"""Registered queries of the operators, over whole tables with production parameters, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.chat import format_chats
from tagloom.llm.chat_repair import key_of, repair_digests
from tagloom.llm.decontaminate import contamination
from tagloom.llm.hard_negatives import hard_negatives
from tagloom.llm.language_crf import languages
from tagloom.llm.near_dedup import near_duplicates
from tagloom.llm.packing import pack
from tagloom.llm.quality import quality_verdicts
from tagloom.llm.sharding import SLOTS, assign, lookup_table
from tagloom.llm.suffix_dedup import repeated_spans
from tagloom.llm.token_counts import token_counts
from tagloom.llm.toxicity import toxicity_scores
from tagloom.llm.warc import ALPHABET, archived

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = spark.range(SHARDS).select(F.format_string("shard-%03d", "id").alias("shard"))
    return assign(table(spark, sf_dir, "documents"), lookup_table(shards))


def op2_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op3_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("carried")


def op8_maximal_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).drop("prefixes")


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults: rows dropped, emptied, without end marks, repeated, or of role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.withColumn("text", F.expr("CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END"))
    rows = rows.withColumn("role", F.expr("IF(fault = 4, 'user', role)"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("sequence(1, IF(fault = 3, 2, 1))")).alias("copy")).drop("copy")


def op12_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repair_digests(damaged(turns))
    out = turns.select("conv_id").distinct().withColumn("key", key_of("conv_id")).join(found, "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_permutation_sharding, op2_crf_language, op3_isolation_forest, op4_suffix_dedup, op5_suffix_automaton, op6_superminhash,
        op7_compression_distance, op8_maximal_chats, op9_prefix_token_counts, op10_bin_completion, op11_kronecker_negatives,
        op12_checkpointed_repair, op13_capture_index,
    )
}

_NUMBER = "CAST('0x' || substr(md5({}), {}, 12) AS BIGINT)"

OP1 = f"""
WITH RECURSIVE shards AS (
  SELECT list(s ORDER BY s.shard) AS s FROM (
    SELECT struct_pack(shard := shard, start := {_NUMBER.format('shard', 1)} % {SLOTS}, skip := {_NUMBER.format('shard', 13)} % {SLOTS - 1} + 1) AS s
    FROM (SELECT 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS shard FROM range({SHARDS}) t(i)))
),
fill(turn, owner, tried) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda x: -1), list_transform(range({SHARDS}), lambda x: 0)
  UNION ALL
  SELECT turn + 1,
    list_concat(list_concat(owner[1:slot], [turn % {SHARDS}]), owner[slot + 2:]),
    list_concat(list_concat(tried[1:turn % {SHARDS}], [j + 1]), tried[turn % {SHARDS} + 2:])
  FROM (
    SELECT *, CAST((sh.start + j * sh.skip) % {SLOTS} AS BIGINT) AS slot FROM (
      SELECT turn, owner, tried, s[turn % {SHARDS} + 1] AS sh,
        list_filter(range(tried[turn % {SHARDS} + 1], {SLOTS}), lambda x: owner[CAST((s[turn % {SHARDS} + 1].start + x * s[turn % {SHARDS} + 1].skip) % {SLOTS} AS BIGINT) + 1] = -1)[1] AS j
      FROM fill, shards WHERE turn < {SLOTS}))
),
slots AS (SELECT unnest(range({SLOTS})) AS slot, unnest(owner) AS i FROM fill WHERE turn = {SLOTS})
SELECT doc_id, CAST(d.slot AS INTEGER) AS slot, s[i + 1].shard AS shard
FROM (SELECT doc_id, {_NUMBER.format("coalesce(CAST(doc_id AS VARCHAR), '')", 1)} % {SLOTS} AS slot FROM documents) d JOIN slots ON slots.slot = d.slot, shards
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS INTEGER), 100) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS s FROM d)),
m AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS first FROM w) WHERE first < doc_id),
b AS (SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM m),
r AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM b) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM r),
k AS (SELECT p.doc_id, sum(z - a) AS n, count(*) AS c, max(z) AS last, string_agg(substr(h, CAST(2 * e + 1 AS INTEGER), CAST(2 * (a - e) AS INTEGER)), '' ORDER BY a) AS head FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_FOLDED.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, array_to_string(w[k + 1:k + n], ' ') AS x FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(0, greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, k, n, array_to_string(w[k + 1:k + n], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, k, o.n, item FROM o JOIN g ON g.x = o.x AND g.n = o.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED.format('[^\\x20\\x09-\\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 5], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP8 = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1099511627776) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, md5(role || chr(31) || text), text) AS x FROM t GROUP BY conv_id),
k AS (SELECT conv_id, x FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.conv_id <> c.conv_id AND len(o.x) >= len(c.x) AND o.x[1:len(c.x)] = c.x AND (len(o.x) > len(c.x) OR o.conv_id < c.conv_id))),
s AS (SELECT conv_id, x, unnest(range(0, (len(x) - 1) // 256 + 1)) AS segment FROM k)
SELECT conv_id, segment, 256 * segment + 1 AS first_place, CAST(len(x[256 * segment + 1:256 * segment + 256]) AS BIGINT) AS n_turns, CAST(len(x) AS BIGINT) AS total_turns,
  array_to_string(list_transform(x[256 * segment + 1:256 * segment + 256], lambda y: '<|im_start|>' || replace(y.role, '<|im_', '<| im_') || chr(10) || replace(y.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10)), '') AS rendered
FROM s
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3
"""

_KEY12 = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_CRC = "list_reduce(list_concat([4294967295], list_transform(range(len({0})), lambda i: CAST(ascii({0}[i + 1]) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))"


def _sql12() -> str:
    far = "{'c': 1000000000, 'a': '', 'o': ''}"
    insert = lambda s, role: f"{{'c': {s}.c + 3, 'a': {s}.a || 'I', 'o': {s}.o || '{role}:' || chr(10)}}"
    keep = lambda s: f"{{'c': {s}.c + extra, 'a': {s}.a || 'K', 'o': {s}.o || role || ':' || text || chr(10)}}"
    turn = lambda s, role: f"{{'c': {s}.c + extra + 3, 'a': {s}.a || 'R', 'o': {s}.o || '{role}:' || text || chr(10)}}"
    gone = lambda s: f"{{'c': {s}.c + 4, 'a': {s}.a || 'D', 'o': {s}.o}}"
    on = lambda test, x: f"CASE WHEN stays AND {test} THEN {x} ELSE {far} END"
    user = f"list_min([U, {insert('Z', 'user')}, {insert('S', 'user')}, {insert('A', 'user')}])"
    return f"""
WITH RECURSIVE n AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC.format('k')}, 4294967295) % 20 AS f
  FROM (SELECT *, {_KEY12} AS k FROM conversations)),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM n)),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy,
  NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut FROM i),
r AS (SELECT *, NOT blank AND copy = 1 AS stays, CASE WHEN cut THEN 3 ELSE 0 END AS extra, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
walk(conv_id, i, Z, S, U, A) AS (
  SELECT DISTINCT conv_id, CAST(1 AS BIGINT), {{'c': 0, 'a': '', 'o': ''}}, {far}, {far}, {far} FROM r
  UNION ALL
  SELECT conv_id, i + 1, {gone('Z')}, list_min([{gone('S')}, {on("c = 's'", keep('Z'))}]),
    list_min([{gone('U')}, {', '.join(on("c = 'u'", keep(s)) for s in 'ZSA')}, {', '.join(on('true', turn(s, 'user')) for s in 'ZSA')}]),
    list_min([{gone('A')}, {on("c = 'a'", keep('U'))}, {on('true', turn('U', 'assistant'))}])
  FROM (SELECT walk.conv_id, walk.i, Z, S, {user} AS U, list_min([A, {insert(user, 'assistant')}]) AS A, role, text, stays, extra, c
    FROM walk JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.i = walk.i)),
e AS (SELECT conv_id, list_min([Z, A, {insert(user, 'assistant')}]) AS x FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND copy > 1) AS duplicate,
  count(*) FILTER (NOT blank AND copy = 1 AND cut) AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.o[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""


OP13 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
h AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(html), CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS x FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}', CAST((x[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM h
"""


ORACLES: dict[str, str] = {
    "op11_kronecker_negatives": OP11, "op12_checkpointed_repair": _sql12(), "op13_capture_index": OP13,
    "op1_permutation_sharding": OP1, "op4_suffix_dedup": OP4, "op5_suffix_automaton": OP5, "op6_superminhash": OP6, "op8_maximal_chats": OP8,
}
