"""The operators on the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marts.llm import (
    chat,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    line_dedup,
    packing,
    phrases,
    pii,
    prefix_trie,
    substring_repeats,
    toxicity,
    warc,
)
from marts.session import new_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The token vocabulary of op10; its place is a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# -- op1: chat formatting ---------------------------------------------------------

OP1_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *,
    length(regexp_replace(role, '(\[/?|</?)(\\*)(ROLE\]|INST\]|s>)', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '(\[/?|</?)(\\*)(ROLE\]|INST\]|s>)', '\1\\\2\3', 'g'))
      + length('<s>[ROLE][/ROLE]</s>') AS chars,
    len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]')) + 4 AS tokens
  FROM all_turns
), placed AS (
  SELECT *,
    row_number() OVER w - 1 AS number,
    coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    coalesce(sum((tokens > 512)::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2
      + (tokens > 512)::BIGINT AS segment,
    CASE WHEN first_value(role) OVER w = 'system' THEN first_value(tokens) OVER w END AS system_tokens,
    CASE WHEN first_value(role) OVER w = 'system' THEN first_value(chars) OVER w END AS system_chars
  FROM escaped WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), celled AS (
  SELECT *, CASE WHEN tokens > 512 THEN 0
    ELSE start // greatest(2048 - 256 - 512 - coalesce(system_tokens, 0), 1) END AS cell
  FROM placed
), cells AS (
  SELECT conv_id, segment, cell, any_value(system_chars) AS system_chars,
    lead(min(start)) OVER w AS next_at, row_number() OVER w - 1 AS win,
    lead(greatest(least(256, 2048 - coalesce(any_value(system_tokens), 0) - sum(tokens)), 0)) OVER w AS next_room
  FROM celled GROUP BY conv_id, segment, cell
  WINDOW w AS (PARTITION BY conv_id ORDER BY segment, cell)
), shown AS (
  SELECT conv_id, sum(c.chars * (1 + (x.next_at IS NOT NULL AND x.next_at - c.start <= x.next_room
    AND NOT (c.number = 0 AND c.role = 'system'))::BIGINT)) AS chars
  FROM celled c JOIN cells x USING (conv_id, segment, cell) GROUP BY conv_id
), systems AS (
  SELECT conv_id, sum(CASE WHEN win > 0 THEN coalesce(system_chars, 0) ELSE 0 END) AS chars
  FROM cells GROUP BY conv_id
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
      FILTER (role = 'assistant'), '') AS learnt
  FROM all_turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars,
  sha256(learnt) AS loss_sha256, (s.chars + y.chars)::BIGINT AS formatted_chars
FROM told JOIN shown s USING (conv_id) JOIN systems y USING (conv_id)
"""


@query("op1_chat_formatting", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    return chat.read_back(chat.chat_windows(given.unionByName(own)))


# -- op2: repeated substrings -----------------------------------------------------


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return substring_repeats.remove_repeats(spark, docs).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# -- op3: personal data -----------------------------------------------------------


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs)).drop("text")
    kinds = ", ".join(f"n_{k} long" for k in pii.KINDS)

    def digest(batches):
        for batch in batches:
            base = [[tuple(s.values()) for s in x] for x in batch["base"].to_pylist()]
            added = [[tuple(s.values()) for s in x] for x in batch["added"].to_pylist()]
            counts = {
                f"n_{k}": pa.array([sum(s[0] == k for s in x) for x in base], pa.int64())
                for k in pii.KINDS
            }
            yield pa.record_batch(
                {"doc_id": batch["doc_id"]}
                | counts
                | {
                    "base_sha256": pa.array(map(pii.base_sha256, base), pa.string()),
                    "spans": pa.array(
                        [pii.span_digest(b + a) for b, a in zip(base, added, strict=True)], pa.string()
                    ),
                    "n_added": pa.array(map(len, added), pa.int64()),
                }
            )

    return found.mapInArrow(digest, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")


# -- op4: exact deduplication -----------------------------------------------------

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op4_exact_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"))


# -- op5: benchmark decontamination -----------------------------------------------


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


# -- op6: n-gram Jaccard join -----------------------------------------------------

OP6_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT d.doc_id, count(s) AS n FROM documents d LEFT JOIN shingles USING (doc_id) GROUP BY d.doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY a, b
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * i >= 80 * (p.n + q.n - i)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT doc_id, n AS n_shingles, min(other) AS component_id
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


@query("op6_jaccard_join", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(spark, table(spark, sf_dir, "documents"))


# -- op7: language identification -------------------------------------------------


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out(F.col("doc_id")).alias("held_out")
    profiles = language_id.language_profiles(docs.where(~held))
    found = language_id.identify(docs.select("doc_id", "text", held), profiles)
    return found.select("doc_id", "held_out", "lang_pred", "score")


# -- op8: repeated lines ----------------------------------------------------------


OP8_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), pieces AS (
  SELECT doc_id, unnest(list_transform(list_filter(string_split(regexp_replace(text,
      '([.!?\x{2026}]+["'')\]\x{BB}\x{201D}\x{2019}]*[\x20\x09\x0B-\x0D]*\n|[.!?\x{2026}]+["'')\]\x{BB}\x{201D}\x{2019}]*[\x20\x09\x0B-\x0D]+|[\x{3002}\x{FF01}\x{FF1F}]+[\x{300D}\x{300F}\x{201D}\x{2019}]*[\x20\x09\x0B-\x0D]*\n?|\n)',
      '\1' || chr(57344), 'g'), chr(57344)),
    lambda x: x <> ''), lambda x, i: {'unit': x, 'i': i})) AS u
  FROM texts
), placed AS (
  SELECT doc_id, u.unit, u.i, regexp_extract_all(lower(u.unit), '[^\x20\x09-\x0D]+') AS words,
    sum(strlen(u.unit)) OVER (PARTITION BY doc_id ORDER BY u.i) AS high
  FROM pieces
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, i) > 1 AS again,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM placed WHERE len(words) > 0
), runs AS (
  SELECT *, k - row_number() OVER (PARTITION BY doc_id, again ORDER BY k) AS run FROM judged
), gone AS (
  SELECT doc_id, i FROM runs WHERE again
  QUALIFY sum(len(words)) OVER (PARTITION BY doc_id, run) >= 20
), marked AS (
  SELECT p.doc_id, p.unit, p.i, (p.high - strlen(p.unit))::BIGINT AS low, p.high::BIGINT AS high,
    g.i IS NOT NULL AS gone
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
), spans AS (
  SELECT doc_id, min(low) AS low, max(high) AS high FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked WHERE gone)
  GROUP BY doc_id, span
), cuts AS (
  SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans,
    '[' || string_agg('{"low":' || low || ',"high":' || high || '}', ',' ORDER BY low) || ']' AS spans
  FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(unit, '' ORDER BY i) AS text FROM marked WHERE NOT gone GROUP BY doc_id
)
SELECT doc_id, strlen(t.text) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  strlen(t.text) - coalesce(n_removed, 0) AS kept_bytes,
  coalesce(n_spans, 0) AS n_spans, coalesce(spans, '[]') AS spans,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN cuts USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


@query("op8_substring_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(line_dedup.drop_repeated_passages(table(spark, sf_dir, "documents")))


@query("op8_sentence_dedup")
def op8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(line_dedup.drop_repeated_sentences(table(spark, sf_dir, "documents")))


def _removed(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"),
        F.size("spans").cast("long").alias("n_spans"),
        F.to_json("spans").alias("spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# -- op9: WARC --------------------------------------------------------------------

OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, strlen(html) AS payload_bytes,
  translate(
    lpad(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32), 8, '0')
    || lpad(to_base(('0x' || substr(h, 11, 10))::BIGINT, 32), 8, '0')
    || lpad(to_base(('0x' || substr(h, 21, 10))::BIGINT, 32), 8, '0')
    || lpad(to_base(('0x' || substr(h, 31, 10))::BIGINT, 32), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


@query("op9_warc", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    warc.write_pages(pages, folder)
    return warc.read_pages(spark, folder)


# -- op10: packing ----------------------------------------------------------------


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(spark, docs, vocabulary()).drop("ids")


# -- op12: toxicity ---------------------------------------------------------------


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn(docs.where(~held).join(labels, "doc_id"))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("sentences"),
    )


# -- op13: conversation prefix trie -----------------------------------------------

OP13_SQL = r"""
WITH RECURSIVE bits(n, step, v) AS (
  SELECT n, 0, n FROM range(256) AS r(n)
  UNION ALL SELECT n, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM bits WHERE step < 8
), crc(conv_id, pos, v) AS (
  SELECT DISTINCT conv_id, 1, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c.conv_id, c.pos + 1, xor(c.v >> 8, b.v)
  FROM crc c JOIN bits b ON b.step = 8 AND b.n = xor(c.v & 255, ascii(substr(c.conv_id::VARCHAR, c.pos, 1)))
  WHERE c.pos <= length(c.conv_id::VARCHAR)
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(
    coalesce(list_slice(b.turns, 1, h.h), []), list_slice(o.turns, h.h + 1, len(o.turns))) AS p
  FROM own o JOIN (SELECT conv_id, xor(v, 4294967295) % 6 AS h FROM crc
    WHERE pos = length(conv_id::VARCHAR) + 1) h USING (conv_id)
  LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), members AS (
  SELECT conv_id, len(p) AS size, d, list_slice(p, 1, d) AS p
  FROM (SELECT conv_id, p, unnest(range(len(p) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM members GROUP BY p, d
), children AS (
  SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT list_slice(p, 1, d) AS p, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT n.p, unnest(range(n.depth + 1)) AS d, c.n IS NULL AS leaf,
      CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.p[n.depth].text) ELSE 0 END AS saved
    FROM nodes n LEFT JOIN children c USING (p))
  GROUP BY 1
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (p) LEFT JOIN children c USING (p)
LEFT JOIN nodes u ON n.depth > 0 AND u.p = list_slice(n.p, 1, n.depth - 1)
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = prefix_trie.turn_sequences(table(spark, sf_dir, "conversations"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rebuilt = prefix_trie.with_shared_heads(sequences, 100, shared, most=5)
    return prefix_trie.trie_nodes(spark, rebuilt)


# -- op11: phrase collocations ----------------------------------------------------

OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), found AS (
  SELECT lang, length, phrase, count(*) AS f FROM (
    SELECT lang, length, array_to_string(list_slice(w, i, i + length - 1), ' ') AS phrase
    FROM (SELECT lang, w, length, unnest(range(1, len(w) - length + 2)) AS i
      FROM split, (VALUES (1), (2), (3), (4)) AS v(length) WHERE len(w) >= length))
  GROUP BY ALL HAVING count(*) >= 30
), worded AS (
  SELECT *, string_split(phrase, ' ') AS w FROM found
), longer AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, w, f, length, m, unnest(range(1, length - m + 2)) AS i
    FROM worded, (VALUES (2), (3)) AS v(m) WHERE m < length)
  GROUP BY 1, 2
), kept AS (
  SELECT w.* FROM worded w LEFT JOIN longer x USING (lang, phrase)
  WHERE w.length > 1 AND (x.longer IS NULL OR 100::HUGEINT * x.longer < 80::HUGEINT * w.f)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, p.f AS l, q.f AS r, (2000000::HUGEINT * c.f) // (p.f + q.f) AS score
  FROM (SELECT *, unnest(range(1, length)) AS k FROM kept) c
  JOIN found p ON p.lang = c.lang AND p.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN found q ON q.lang = c.lang AND q.phrase = array_to_string(list_slice(c.w, k + 1, c.length), ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_phrase_mining", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, table(spark, sf_dir, "documents"))
