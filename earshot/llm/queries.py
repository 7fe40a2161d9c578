"""The registered queries of this subpackage: each applies an operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, divergence, language, media, mixing, ngram_lm, packing, prefix_trie, quality, sharding, simhash, substrings, topk
from .common import byte_length, shuffle_width, table

SHARDS = 24


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing of the id, with gapless slots."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (byte_length("text") + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard(docs, SHARDS)
    slotted = sharding.with_slots(placed, order=["doc_id", "size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that 13-word windows of earlier documents cover."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents."""
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, every source at its share of the corpus in each."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents that bring the sources to shares tempered by 0.7, at one epoch."""
    docs = table(spark, sf_dir, "documents")
    copies = mixing.shuffled(mixing.replicate(docs, temperature=0.7, epochs=1.0), shuffle_width(spark))
    # Digests of the shuffled documents, so that Spark cannot leave any column out of the shuffle.
    digests = (F.md5(F.col("text").cast("binary")).alias("text_md5"), byte_length("text").alias("text_bytes"), "lang", "n_chars")
    return copies.select("doc_id", "source", F.round("rate", 9).alias("rate"), F.col("copies").cast("long"), F.col("copy").cast("long"), "place", *digests)


def op7_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products for each twentieth vector, against all rows."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op8_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return language.language_scores(table(spark, sf_dir, "documents"))


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all texts kept in progressive JPEG files, and of what is read back from these."""
    read = media.from_media(media.to_media(table(spark, sf_dir, "documents")))
    payload = F.octet_length("payload")
    return read.select(
        "doc_id",
        "n_bytes",
        payload.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), payload - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: four-word shingles, links at four or fewer differing bits."""
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicate_classes(docs, shingle=4, max_distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language, and the terms that set a source apart from its language."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_swap_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 4096 tokens as the local search finds."""
    pieces = best_fit.pack_best_fit(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    nodes = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    "op1_jump_sharding": op1_jump_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_elias_fano_lm": op3_elias_fano_lm,
    "op4_quality_discriminant": op4_quality_discriminant,
    "op5_mixture_packing": op5_mixture_packing,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_columnar_topk": op7_columnar_topk,
    "op8_language_bayes": op8_language_bayes,
    "op9_progressive_jpeg": op9_progressive_jpeg,
    "op10_simhash_popcount": op10_simhash_popcount,
    "op11_source_divergence": op11_source_divergence,
    "op12_swap_best_fit": op12_swap_best_fit,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES = {
    # crc32 bit by bit; the jump hash walks one jump a round in 128-bit integers.
    "op1_jump_sharding": """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([r, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY r) AS t
  FROM range(256) AS x(r)),
walk AS (
  SELECT doc_id, coalesce(doc_id, 0)::UHUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, k, j, floor((j + 1) * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (key * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS k
        FROM walk WHERE j < 24)),
placed AS (SELECT doc_id, max(b) AS shard, max(CASE WHEN j = 24 THEN 24 ELSE b END) AS grown FROM walk WHERE j >= 24 GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, coalesce(strlen(text), 0) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(text))]),
      lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents) d, crc_table)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM sized JOIN placed USING (doc_id)
""",
    "op2_substring_dedup": """
WITH words AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
windows AS (
  SELECT doc_id, pos, word, CASE WHEN lead(word, 12) OVER w IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w, lead(word, 5) OVER w, lead(word, 6) OVER w, lead(word, 7) OVER w, lead(word, 8) OVER w, lead(word, 9) OVER w, lead(word, 10) OVER w, lead(word, 11) OVER w, lead(word, 12) OVER w) END AS key
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
firsts AS (SELECT key, min(doc_id) AS first_id FROM windows WHERE key IS NOT NULL GROUP BY key),
marked AS (
  SELECT doc_id, pos, word, max(CASE WHEN first_id < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM windows LEFT JOIN firsts USING (key)),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op6_poisson_mixing": """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes FROM documents GROUP BY source),
wanted AS (SELECT source, bytes, CASE WHEN bytes > 0 THEN pow(bytes, 0.7) ELSE 0 END AS w FROM sizes),
rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN 1.0::DOUBLE * (w / sum(w) OVER ()) * sum(bytes) OVER () / bytes ELSE 1.0 END AS rate
  FROM wanted),
drawn AS (
  SELECT d.doc_id, d.source, rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps AS (
  SELECT doc_id, source, rate, u, exp(-rate) AS p, exp(-rate) AS cdf, 0 AS k FROM drawn
  UNION ALL
  SELECT doc_id, source, rate, u, p * rate / (k + 1), cdf + p * rate / (k + 1), k + 1 FROM steps WHERE cdf <= u),
counted AS (SELECT doc_id, source, rate, k AS copies FROM steps WHERE cdf > u AND k > 0)
SELECT doc_id, source, round(rate, 9) AS rate, copies::BIGINT AS copies, c::BIGINT AS copy,
  ('0x' || substr(md5('mix-1-place:' || coalesce(doc_id::VARCHAR, 'null') || ':' || c), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS place,
  text_md5, text_bytes, lang, n_chars
FROM (SELECT *, unnest(range(copies)) AS c FROM counted)
JOIN (SELECT doc_id, md5(text) AS text_md5, coalesce(strlen(text), 0) AS text_bytes, lang, n_chars FROM documents) USING (doc_id)
""",
    "op7_columnar_topk": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    # Every source with every kept term, zeros included, in 128-bit integers.
    "op11_source_divergence": """
WITH docs AS (
  SELECT row_number() OVER () AS n_doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
words AS (SELECT n_doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT n_doc) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
tf AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER g AS total, count(*) OVER g AS v
  FROM groups JOIN kept USING (lang) LEFT JOIN tf USING (lang, source, term) WINDOW g AS (PARTITION BY lang, source)),
shares AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER t + 5)) // (sum(n) OVER l + 5 * v) AS q
  FROM cells WINDOW t AS (PARTITION BY lang, term), l AS (PARTITION BY lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    # A node is named by its smallest member and its depth; a conversation's node at a depth is found by its list of turns.
    "op13_conversation_trie": """
WITH crc_table AS (
  SELECT list(list_reduce([r, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY r) AS t
  FROM range(256) AS x(r)),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
shares AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
      lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:h], s.turns[h + 1:]) AS turns
  FROM shares s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 20),
path AS (
  SELECT conv_id, depth, turns[1:depth] AS prefix, len(turns) AS turns,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(turns[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
owned AS (SELECT conv_id, depth, turns, words, min(conv_id) OVER (PARTITION BY depth, prefix) AS owner FROM path),
nodes AS (
  SELECT owner, depth, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM owned GROUP BY owner, depth),
parents AS (
  SELECT n.*, o.owner AS parent FROM nodes n LEFT JOIN owned o ON o.conv_id = n.owner AND o.depth = n.depth - 1),
children AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children c USING (owner, depth)),
sums AS (
  SELECT o.owner, o.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens
  FROM full_nodes u JOIN owned o ON o.conv_id = u.owner AND o.depth <= u.depth GROUP BY o.owner, o.depth)
SELECT owner AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (owner, depth)
""",
}
