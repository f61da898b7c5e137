"""One query an operator over its whole table, and the pipeline; ``ORACLE`` has the SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpuskiln.llm.bpe import round_trip_digests
from corpuskiln.llm.chat_tree import CONTROL, format_tree, read_back
from corpuskiln.llm.edit_counts import count_with_edits
from corpuskiln.llm.exact_dedup import exact_duplicates
from corpuskiln.llm.html_extract import extract_pages
from corpuskiln.llm.line_dedup import drop_repeated_lines
from corpuskiln.llm.merkle import manifest, verify
from corpuskiln.llm.ngram_join import similar_documents
from corpuskiln.llm.packing import pack
from corpuskiln.llm.quality import COUNTS, judge
from corpuskiln.llm.tokenizer_files import tokenizer_path
from corpuskiln.llm.toxicity import toxicity
from corpuskiln.llm.whitening import whiten
from corpuskiln.llm.zip_warc import locate_records, read_records, typed_pages, write_packages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def with_sample_edits(docs: DataFrame) -> DataFrame:
    """Four edits of every document, made of its own text: replace, delete, insert at the start, append."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(text)

    def edit(seq: int, start, length: int, replacement):
        return F.struct(
            F.lit(seq).cast("bigint").alias("seq"),
            F.floor(start).cast("bigint").alias("start"),
            F.lit(length).cast("bigint").alias("length"),
            replacement.alias("replacement"),
        )

    edits = F.array(
        edit(0, n / 3, 7, F.substring(text, 1, 20)),
        edit(1, n / 2, 5, F.lit("")),
        edit(2, F.lit(0), 0, F.lit("Draft: ")),
        edit(3, n + 100, 0, F.lit(" the end.")),
    )
    return docs.select("doc_id", "text", edits.alias("edits"))


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(with_sample_edits(_table(spark, sf_dir, "documents")), tokenizer_path())


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_tree(turns.unionByName(extra)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(typed_pages(_table(spark, sf_dir, "pages")))
    found = read_records(locate_records(packages), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(manifest(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_packing,
        op3_exact_dedup,
        op4_quality_rules,
        op5_ngram_jaccard_join,
        op6_edit_aware_counts,
        op7_bpe_round_trip,
        op8_line_dedup,
        op9_chat_formatting,
        op10_warc,
        op11_toxicity,
        op12_embedding_whitening,
        op13_merkle_manifest,
    )
} | {"pipeline": corpus_pipeline.run}

OP3 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP8 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), windows AS (
  SELECT doc_id, pos, line,
         lead(line, 1) OVER doc AS second, lead(line, 2) OVER doc AS third, lead(pos, 2) OVER doc AS last
  FROM lines WINDOW doc AS (PARTITION BY doc_id ORDER BY pos)
), places AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, pos) AS place
  FROM windows WHERE last IS NOT NULL
), later AS (SELECT doc_id, pos FROM places WHERE place > 1),
covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS t(k)
)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
GROUP BY l.doc_id
"""

_CONTROL_SQL = CONTROL.replace("'", "''")
OP9 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), loss AS (
  SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS said
  FROM turns GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         sum(length(role) + length(regexp_replace(text, '{_CONTROL_SQL}', '\1\\\2\3', 'g')) + 24)::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted_chars
FROM whole JOIN loss USING (conv_id)
"""

# crc is the checksum of the decimal id, bit by bit: xor with a byte, then eight shifts by the reversed polynomial
OP13 = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS src,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS cut,
         list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
           lambda digit: [ascii(digit)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY src) - 1 AS tree,
         row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY src) AS n,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(CASE WHEN crc & 1 = 1 THEN cut ELSE text END) || ':'
           || CASE WHEN crc & 1 = 1 THEN cut ELSE text END, '-')) AS shown
  FROM rows_
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, max(level) + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, idx // 3
), subroots AS (
  SELECT tree, level AS height, digest AS subroot FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT max(level) + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper_nodes WHERE n > 1 GROUP BY idx // 3
), siblings AS (
  SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS r
  FROM (SELECT tree, level, idx, n, digest FROM nodes UNION ALL SELECT -1, level, idx, n, digest FROM upper_nodes)
  WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, idx // 3 ORDER BY idx)
), steps AS (
  SELECT f.tree, f.idx, s.level AS step, s.l, s.r
  FROM leaves f JOIN siblings s ON s.tree = f.tree AND s.idx = f.idx // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT f.tree, f.idx, u.height + s.level, s.l, s.r
  FROM leaves f JOIN subroots u ON u.tree = f.tree
  JOIN siblings s ON s.tree = -1 AND s.idx = f.tree // (3 ** s.level)::BIGINT
), proofs AS (
  SELECT tree, idx, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY tree, idx
), folded AS (
  SELECT tree, idx, 0 AS step, shown AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.idx, f.step + 1, sha256(s.l || f.h || s.r) FROM folded f JOIN steps s USING (tree, idx, step)
), ends AS (
  SELECT tree, idx, max_by(h, step) AS folded_root FROM folded GROUP BY tree, idx
)
SELECT doc_id, leaf, subroot, digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = digest AS verified
FROM leaves JOIN subroots USING (tree) JOIN ends USING (tree, idx) LEFT JOIN proofs USING (tree, idx)
JOIN upper_nodes u ON u.n = 1
"""

ORACLE: dict[str, str] = {"op3_exact_dedup": OP3, "op8_line_dedup": OP8, "op9_chat_formatting": OP9, "op13_merkle_manifest": OP13}
