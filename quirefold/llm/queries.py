"""Queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import chat, fingerprints, hamming, jaccard_join, langid, license_scan, mixing, ngram_lm, packing, phrases, pii, prefix_trie, store
from quirefold.llm.common import bucket_of


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_chats(rows.unionByName(own))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS joined,
    replace(replace(role, '\', '\\'), '<|', '<\|') AS erole, replace(replace(text, '\', '\\'), '<|', '<\|') AS etext
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(etext) + CASE WHEN joined THEN length('<|part|>') ELSE length('<|role|>') + length(erole) + length('<|text|>') + length('<|end|>') + 1 END) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), x AS (SELECT doc_id, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 90 * (len(sa.g) + len(sb.g) - n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT sides.b, reached.c FROM reached JOIN sides ON sides.a = reached.doc_id WHERE reached.c < sides.b)
SELECT s.doc_id, CAST(any_value(len(g)) AS BIGINT) AS n_shingles, min(c) AS component_id FROM s JOIN reached ON reached.doc_id = s.doc_id GROUP BY s.doc_id
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_neighbour(_table(spark, sf_dir, "documents"))
    n = F.length("text")
    m = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", n - m), F.left("next_text", m)))
    rows = fingerprints.with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.write_store(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), cut="white_space", end_id=2)
    return store.read_checksums(spark, path)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.span_list(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
    )


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return hamming.nearest(rows, "vec_id", hamming.sign_code(F.col("embedding")), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id,
    CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CASE WHEN p[1] = p[2] THEN 0 ELSE 1 END)) AS INTEGER) AS distance
  FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
SELECT query_id, neighbour_id, distance, rank FROM r WHERE rank <= 10
"""


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), cut="before_space", end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    """Every block of every document against every template."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in sorted(ws)) + "]"
    templates = ", ".join(f"({k}, '{t.label}', {quoted(t.words)}, {t.span}, {t.least})" for k, t in enumerate(license_scan.templates_of(license_scan.TEMPLATES, 90)))
    phrases = ", ".join("(" + "[" + ", ".join(f"'{w}'" for w in p.split()) + "]" + f", '{label}')" for p, label in license_scan.PHRASES)
    return rf"""
WITH t(k, label, toks, span, least) AS (VALUES {templates}), q(ws, label) AS (VALUES {phrases}),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (SELECT doc_id, q.label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(q.ws)] = q.ws)) AS place FROM w, q),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS ls FROM p GROUP BY doc_id),
b AS (SELECT doc_id, span, unnest(range(0, CAST(ceil(len(w) / span) AS BIGINT))) AS block, w FROM w, (SELECT DISTINCT span FROM t)),
m AS (SELECT doc_id, b.span, block, k, label, toks, least, len(list_intersect(list_distinct(w[block * b.span + 1:(block + 2) * b.span]), toks)) AS common FROM b JOIN t ON t.span = b.span),
g AS (SELECT * FROM m WHERE common >= least),
u AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g AS x WHERE x.doc_id = g.doc_id AND x.span = g.span AND x.block = g.block AND len(x.toks) > len(g.toks) AND list_has_all(x.toks, g.toks))),
found AS (SELECT doc_id, list(DISTINCT label) AS ls, max(common / len(toks)) AS best FROM u GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN found ON found.doc_id = w.doc_id
"""


OP11_SQL = _op11_sql()


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.numbered(_table(spark, sf_dir, "conversations"))
    keep = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(6))
    trie = prefix_trie.build(*prefix_trie.splice(turns, convs, F.col("c") - F.col("c") % 100, keep, most=5))
    out = trie.nodes.join(prefix_trie.end_digests(trie), prefix_trie.NODE, "left")
    counts = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select("conv_id", *counts, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, length(coalesce(text, '')) AS n_chars
  FROM conversations
), v AS (
  SELECT c, c - c % 100 AS b, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1))))) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)
),
r AS (
  SELECT v.c, 0 AS own, t.pos, t.said, t.n_chars FROM v JOIN t ON t.c = v.b AND t.pos <= v.h
  UNION ALL SELECT v.c, 1, t.pos, t.said, t.n_chars FROM v JOIN t ON t.c = v.c AND t.pos > v.h
), d AS (
  SELECT c, row_number() OVER w AS depth, sha256(string_agg(said, '') OVER (w ROWS UNBOUNDED PRECEDING)) AS node, n_chars FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos)
  UNION ALL SELECT c, 0, 'root', 0 FROM v
), u AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS up, lead(node) OVER (PARTITION BY c ORDER BY depth) IS NULL AS ends FROM d),
n AS (
  SELECT node, any_value(depth) AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM u GROUP BY node
), k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT DISTINCT a.node AS top, x.node FROM u AS a JOIN u AS x ON x.c = a.c AND x.depth >= a.depth),
s AS (
  SELECT top, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.n_chars) AS saved_tokens
  FROM below JOIN n ON n.node = below.node LEFT JOIN k ON k.node = below.node GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n AS p ON p.node = n.up
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, unnest(list_transform(range(1, greatest(len(w) - m + 2, 1)), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) AS r(m)
), c AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM f GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, k, array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS y FROM c, range(1, 5) AS r(k) WHERE k < c.m
), s AS (
  SELECT cut.*, cx.f AS l, cy.f AS r, n.n, 1000 * a * n.n // (cx.f * cy.f) AS score
  FROM cut JOIN c cx ON cx.lang = cut.lang AND cx.phrase = x JOIN c cy ON cy.lang = cut.lang AND cy.phrase = y JOIN n ON n.lang = cut.lang
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND c.f >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm_score": op1_lm_score, "op2_chat_format": op2_chat_format, "op3_jaccard_join": op3_jaccard_join, "op4_fingerprints": op4_fingerprints, "op5_id_store": op5_id_store, "op6_mix_sources": op6_mix_sources, "op7_language_id": op7_language_id, "op8_pii": op8_pii, "op9_hamming_topk": op9_hamming_topk, "op10_pack": op10_pack, "op11_license_scan": op11_license_scan, "op12_prefix_trie": op12_prefix_trie, "op13_phrases": op13_phrases}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op9_hamming_topk": OP9_SQL, "op11_license_scan": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_phrases": OP13_SQL}
