"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import (
    ann,
    chat_format,
    conversation_trie,
    decontamination,
    exact_search,
    lexical_search,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    substring_dedup,
    token_store,
    toxicity,
)
from strandloom.llm.shared import scratch_path, write_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), win AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER twenty AS run, count(*) OVER twenty AS n FROM word
  WINDOW twenty AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), placed AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS place FROM win WHERE n = 20
), hit AS (
  SELECT DISTINCT doc_id, p + j AS p FROM placed, range(0, 20) AS r(j) WHERE place > 1
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), within=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"),
    )


OP2_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM lowered
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS run
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), long_run AS (
  SELECT doc_id, p, string_agg(word, ' ') OVER thirteen AS run, count(*) OVER thirteen AS n FROM word
  WINDOW thirteen AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), short_run AS (
  SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS run
  FROM d, (SELECT DISTINCT size FROM item WHERE size < 13), unnest(range(1, len(w) - size + 2)) AS t(p)
), met AS (
  SELECT doc_id, p, item_id, size FROM long_run JOIN item USING (run) WHERE n = 13 AND size = 13
  UNION ALL
  SELECT doc_id, p, item_id, size FROM short_run JOIN item USING (run, size)
), hit AS (
  SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM met, range(0, 13) AS r(j) WHERE j < size GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
), numbered AS (
  SELECT item_id, w, row_number() OVER () AS item FROM b WHERE len(w) > 0
), spot AS (
  SELECT item, item_id, i AS start, unnest(range(0, least(13, len(w)))) AS k, unnest(w[i : i + least(13, len(w)) - 1]) AS word
  FROM numbered, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i)
), used AS (
  SELECT word, count(*) AS n FROM word WHERE word IN (SELECT word FROM spot) GROUP BY word
), rare AS (
  SELECT item, item_id, start, word, row_number() OVER (PARTITION BY item, start ORDER BY coalesce(n, 0), k) AS rank
  FROM spot LEFT JOIN used USING (word)
), pair AS (
  SELECT DISTINCT item_id, min(word) AS a, max(word) AS b FROM rare WHERE rank <= 2 GROUP BY item, item_id, start
), place AS (
  SELECT doc_id, word, p FROM word WHERE word IN (SELECT a FROM pair UNION SELECT b FROM pair)
), near AS (
  SELECT DISTINCT x.doc_id, pair.item_id FROM (SELECT DISTINCT a, b FROM pair) AS ab JOIN place AS x ON x.word = a
  JOIN place AS y ON y.word = b AND y.doc_id = x.doc_id AND abs(x.p - y.p) < 13 JOIN pair USING (a, b)
), close AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near_items FROM near GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near_items, '')) AS near_items_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN close USING (doc_id)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS spot
  FROM documents
), filled AS (
  SELECT doc_id, spot, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS k
  FROM line WHERE trim(line, ' ') <> ''
), win AS (
  SELECT doc_id, k, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM filled
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), placed AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS place FROM win WHERE c IS NOT NULL
), cut AS (
  SELECT DISTINCT doc_id, spot FROM (SELECT doc_id, k + j AS k FROM placed, range(0, 3) AS r(j) WHERE place > 1)
  JOIN filled USING (doc_id, k)
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY spot) AS text FROM line ANTI JOIN cut USING (doc_id, spot) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_lines FROM filled GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_removed FROM cut GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN documents.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _op6_sql() -> str:
    known = ", ".join(f"('{words}', '{name}')" for name, words in licenses.SENTENCES.items())
    rules = ", ".join(f"('{name}', '{licenses.rule_pattern(ids)}')" for name, ids in licenses.RULES)
    line = "' ' || string_agg(id, '  ' ORDER BY p) || ' '"
    for one, two in licenses.JOINED:
        line = f"replace({line}, ' {one}  {two} ', ' {one}+{two} ')"
    named = "CASE " + " ".join(f"WHEN contains(w, '{part}') THEN '{name}'" for name, part in licenses.NAMED.items()) + " END"
    return rf"""
WITH known(words, id) AS (VALUES {known}), rule(license, pattern) AS (VALUES {rules}), held AS (
  SELECT doc_id, text, regexp_replace(regexp_replace(text, '{licenses.BEFORE_ADDRESS}', ' \1', 'g'), '{licenses.BLANK_LINES}', chr(1), 'g') AS t
  FROM documents
), para AS (
  SELECT doc_id, text, translate(t, chr(10) || chr(1), ' ' || chr(10)) AS para FROM held
), view AS (
  SELECT doc_id, 0 AS view, string_split_regex(text, '{licenses.SENTENCE_END}') AS s FROM para
  UNION ALL SELECT doc_id, 1, string_split_regex(replace(text, chr(10), ' '), '{licenses.SENTENCE_END}') FROM para
  UNION ALL SELECT doc_id, 2, string_split_regex(para, '{licenses.SENTENCE_END}') FROM para
  UNION ALL SELECT doc_id, 3, string_split_regex(text, '{licenses.FULL_STOP}') FROM para
  UNION ALL SELECT doc_id, 4, string_split_regex(para, '{licenses.FULL_STOP}') FROM para
), sentence AS (
  SELECT doc_id, view, unnest(s) AS s, unnest(range(0, len(s))) AS p FROM view
), normal AS (
  SELECT doc_id, view, p, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS w FROM sentence
), bare AS (
  SELECT doc_id, view, p, CASE WHEN regexp_matches(w, '^[0-9]{{1,2}} [a-z]{{3}}') THEN w[instr(w, ' ') + 1 :] ELSE w END AS w FROM normal
), met AS (
  SELECT doc_id, view, p, coalesce(id, {named}) AS id FROM bare LEFT JOIN known ON words = w
), seq AS (
  SELECT doc_id, view, count(*) AS n, string_agg(id, ',' ORDER BY p) AS ids, {line} AS line FROM met WHERE id IS NOT NULL GROUP BY doc_id, view
), named AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses
  FROM (SELECT DISTINCT doc_id, license FROM seq JOIN rule ON regexp_matches(line, pattern)) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentences,
       coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN (SELECT * FROM seq WHERE view = 0) USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p, len(w) AS size FROM d
), run AS (
  SELECT doc_id, size, p, string_agg(word, ' ') OVER three AS shingle, count(*) OVER three AS n FROM word
  WINDOW three AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), s AS (
  SELECT DISTINCT doc_id, shingle FROM run WHERE n = 3 OR (size < 3 AND p = 1)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s AS a JOIN s AS b USING (shingle)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pair JOIN sizes AS a ON a.doc_id = x JOIN sizes AS b ON b.doc_id = y
  WHERE 100 * shared >= 90 * (a.n + b.n - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, y FROM reach AS r JOIN link ON r.other = x
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    examples = write_table(chat_format.prefix_examples(turns.unionByName(own)), "chat")
    talks = chat_format.read_examples(examples)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return talks.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 15 AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM said
), run AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS until FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(until) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(
        _table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), keep_space=False, end_id=2
    )
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"), family=20)


OP11_SQL = r"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, conv_id - conv_id % 20 AS origin, xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda r, b: list_reduce(
    list_concat([xor(r, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM said)
), turns AS (
  SELECT crc.conv_id, 0 AS part, p, role, text FROM crc JOIN said ON said.conv_id = origin AND p < h
  UNION ALL SELECT conv_id, 1, p, role, text FROM said JOIN crc USING (conv_id) WHERE p >= h
), step AS (
  SELECT conv_id, row_number() OVER w AS depth, text, string_agg(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), '') OVER w AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
), path AS (
  SELECT conv_id, depth, prefix, text FROM step UNION ALL SELECT conv_id, 0, '', '' FROM crc
), last AS (
  SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id
), node AS (
  SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs,
         (count(*) - 1) * max(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS own FROM path GROUP BY depth, prefix
), named AS (
  SELECT path.conv_id AS member, path.depth, node.conv_id, node.n_convs, node.own FROM path JOIN node USING (depth, prefix)
), linked AS (
  SELECT node.conv_id, node.depth, node.n_convs, node.own, up.conv_id AS parent_conv_id
  FROM node LEFT JOIN named AS up ON up.member = node.conv_id AND up.depth = node.depth - 1
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), whole AS (
  SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (conv_id, depth)
), summed AS (
  SELECT above.conv_id, above.depth, sum(CAST(below.n_children = 0 AS BIGINT)) AS n_leaves, sum(below.own) AS saved
  FROM whole AS below JOIN named AS above ON above.member = below.conv_id AND above.depth <= below.depth GROUP BY ALL
), ended AS (
  SELECT named.conv_id, named.depth, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS ids
  FROM named JOIN last ON last.conv_id = member AND last.depth = named.depth GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole JOIN summed USING (conv_id, depth) LEFT JOIN ended USING (conv_id, depth)
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH word AS (
  SELECT doc_id, row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS row_no FROM documents) WHERE doc_id IS NOT NULL
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), size AS (
  SELECT row_no, count(*) AS n FROM word GROUP BY row_no
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size
), posted AS (
  SELECT doc_id, row_no, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posted, total GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM posted JOIN asked USING (term) JOIN weight USING (term) JOIN size USING (row_no), total GROUP BY item_id, doc_id, row_no
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.largest_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_ngram_join": op7_ngram_join,
    "op8_chat_format": op8_chat_format,
    "op9_token_store": op9_token_store,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_search": op13_exact_search,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op6_licenses": _op6_sql(),
    "op7_ngram_join": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_exact_search": OP13_SQL,
}
