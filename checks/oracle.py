"""The queries of ``checks.queries`` as SQL over the same tables."""

from __future__ import annotations

from checks.derived import OWNERS, PROSE, STOPS

BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PRE_TOKEN = (
    r"''(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+"
)


def hex_int(text: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def draw(key: str, salt: str, seed: int) -> str:
    return f"({hex_int(f'''{key} || ':{salt}:{seed}' ''', 8)} / CAST(4294967296 AS DOUBLE))"


def order_hash(key: str, seed: int) -> str:
    return f"md5({key} || ':{seed}')"


def pieces(text: str) -> str:
    return f"string_split_regex({text}, '{BREAK}')"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{PRE_TOKEN}')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[^A-Za-z_0-9]'), lambda w: length(w) > 0)"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def count_of(text: str, word: str) -> str:
    return f"((length({text}) - length(replace({text}, '{word}', ''))) // {len(word)})"


def any_of(text: str, keywords: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{word}')" for word in keywords) + ")"


RAW = """raw AS (
  SELECT doc_id, source || '/' || lang AS repo_name,
         'd' || doc_id || CASE WHEN lang = 'fr' THEN '.md' ELSE '.py' END AS path,
         '1' AS copies, CAST(n_chars AS VARCHAR) AS size, text AS content
  FROM documents)"""

OWNER = "owners(owner, org) AS (VALUES " + ", ".join(
    f"('{owner}', '{org}')" for org, names in OWNERS.items() for owner in names
) + ")"

ROUTED = f"""{RAW}, {OWNER}, routed AS (
  SELECT raw.doc_id, raw.repo_name, raw.path, raw.copies, CAST(raw.size AS BIGINT) AS size, raw.content, owners.org
  FROM raw JOIN owners ON split_part(raw.repo_name, '/', 1) = owners.owner)"""

FEATURES = f"""prepared AS (
  SELECT doc_id, text, {pieces('text')} AS pieces, lower(text) AS low FROM documents),
measured AS (
  SELECT *, list_transform(pieces, lambda p: length(p)) AS lens,
         len(pieces) - CASE WHEN pieces[-1] = '' THEN 1 ELSE 0 END AS n_lines,
         lower(array_to_string(pieces[1:5], chr(10))) AS head
  FROM prepared),
features AS (
  SELECT doc_id, md5(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS hash,
         CAST(list_sum(lens) AS DOUBLE) / n_lines AS line_mean,
         list_max(lens) AS line_max,
         CAST(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS DOUBLE) / length(text) AS alpha_frac,
         CAST(length(text) AS DOUBLE) / len({tokens('text')}) AS ratio,
         {any_of('head', ('auto-generated', 'autogenerated', 'automatically generated'))} AS autogenerated,
         {any_of('head', ('unit tests', 'test file', 'configuration file'))}
           OR {count_of('low', 'config')} > {count_of('low', chr(10))} // 20
           OR {count_of('low', 'test')} > {count_of('low', chr(10))} // 20 AS config_or_test,
         NOT {any_of('low', ('def ', 'class ', 'for ', 'while '))} AS has_no_keywords,
         {count_of('text', '=')} <= 4 AS has_few_assignments
  FROM measured)"""

REASONS = f"""{FEATURES}, judged AS (
  SELECT doc_id, hash, line_mean, alpha_frac, ratio,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY hash) THEN 'duplicate'
         WHEN autogenerated THEN 'autogenerated'
         WHEN line_max > {PROSE.line_max} THEN 'line_max'
         WHEN line_mean > {PROSE.line_mean} THEN 'line_mean'
         WHEN alpha_frac < {PROSE.alpha_frac} THEN 'alpha_frac'
         WHEN ratio < {PROSE.min_token_ratio} THEN 'ratio'
         WHEN config_or_test AND {draw('doc_id', 'config_or_test', 1)} <= CAST(0.7 AS DOUBLE) THEN 'config_or_test'
         WHEN has_no_keywords AND {draw('doc_id', 'has_no_keywords', 1)} <= CAST(0.7 AS DOUBLE) THEN 'has_no_keywords'
    END AS drop_reason
  FROM features)"""

TOKEN_SETS = f"""worded AS (SELECT doc_id, {words('text')} AS words FROM documents),
sets AS (SELECT doc_id, list_distinct(words) AS tokens FROM worded)"""

SIGNATURES = f"""{TOKEN_SETS},
hashed AS (
  SELECT DISTINCT doc_id, {hex_int('token', 7)} AS h
  FROM (SELECT doc_id, unnest(list_distinct(words)) AS token FROM worded WHERE len(words) >= 10)),
family AS (
  SELECT i, 1 + {hex_int("'a' || i", 7)} AS a, {hex_int("'b' || i", 7)} AS b FROM range(256) AS r(i)),
slots AS (
  SELECT doc_id, i, min((a * h + b) % 2147483647) AS slot FROM hashed CROSS JOIN family GROUP BY doc_id, i)"""

SHARED = f"""{SIGNATURES},
banded AS (
  SELECT doc_id, (i // 19) || ':' || string_agg(CAST(slot AS VARCHAR), ',' ORDER BY i) AS bucket
  FROM slots WHERE i < 247 GROUP BY doc_id, i // 19),
shared AS (
  SELECT * FROM (
    SELECT bucket, doc_id, min(doc_id) OVER (PARTITION BY bucket) AS root, count(*) OVER (PARTITION BY bucket) AS n
    FROM banded) WHERE n > 1)"""

PAIRS = f"""{SHARED},
pairs AS (
  SELECT DISTINCT id_a, id_b FROM (
    SELECT root AS id_a, doc_id AS id_b FROM shared)
  WHERE id_a < id_b)"""

COMPONENTS = f"""{PAIRS},
ends AS (SELECT id_a AS u, id_b AS v FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach(id, other) AS (
  SELECT u, u FROM ends UNION SELECT reach.id, ends.v FROM reach JOIN ends ON reach.other = ends.u),
members AS (SELECT min(other) AS cluster_id, id FROM reach GROUP BY id)"""

GREEDY = f"""{SHARED},
mates AS (
  SELECT k.doc_id AS id, list_sort(list_distinct(list(c.doc_id))) AS cands
  FROM shared k JOIN shared c ON k.bucket = c.bucket AND c.doc_id < k.doc_id GROUP BY k.doc_id),
turns AS (SELECT id, cands, row_number() OVER (ORDER BY id) AS turn FROM mates),
replay(turn, bases, id, base) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT turn, CASE WHEN list_contains(bases, base) THEN bases ELSE list_append(bases, base) END, id, base
  FROM (
    SELECT turns.turn, replay.bases, turns.id,
           coalesce(list_filter(turns.cands, lambda c: list_contains(replay.bases, c))[1], turns.cands[1]) AS base
    FROM replay JOIN turns ON turns.turn = replay.turn + 1)),
chosen AS (SELECT id, base FROM replay WHERE id IS NOT NULL),
members AS (
  SELECT DISTINCT base AS cluster_id, base AS id FROM chosen UNION ALL SELECT base, id FROM chosen)"""

JACCARD = (
    "CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
)


def outcome(members: str) -> str:
    similarity = JACCARD.format(a="x.tokens", b="y.tokens")
    return f"""{members},
left_over(step, cluster_id, id) AS (
  SELECT 0, cluster_id, id FROM members
  UNION ALL
  SELECT o.step + 1, o.cluster_id, o.id
  FROM (SELECT *, min(id) OVER (PARTITION BY cluster_id) AS pivot FROM left_over) o
  JOIN sets x ON x.doc_id = o.id JOIN sets y ON y.doc_id = o.pivot
  WHERE o.id <> o.pivot AND {similarity} < CAST(0.85 AS DOUBLE)),
pivots AS (SELECT step, cluster_id, min(id) AS extreme_id FROM left_over GROUP BY step, cluster_id),
outcome AS (
  SELECT cluster_id, id, extreme_id
  FROM (SELECT cluster_id, id, max(step) AS step FROM left_over GROUP BY cluster_id, id) last
  JOIN pivots USING (cluster_id, step))"""


OUTCOME = outcome(COMPONENTS)
OUTCOME_GREEDY = outcome(GREEDY)
REMOVED = "removed AS (SELECT id FROM outcome GROUP BY id HAVING NOT bool_or(id = extreme_id))"
ANNOTATED = """copied AS (
  SELECT id, max(copies) AS copies
  FROM (SELECT cluster_id, extreme_id AS id, count(*) AS copies FROM outcome GROUP BY ALL) GROUP BY id),
annotated AS (
  SELECT o.cluster_id, o.id, d.source || '/' || d.lang AS repo_name,
         'd' || d.doc_id || CASE WHEN d.lang = 'fr' THEN '.md' ELSE '.py' END AS path,
         c.copies IS NOT NULL AS is_extreme, c.copies
  FROM outcome o JOIN documents d ON d.doc_id = o.id LEFT JOIN copied c USING (id))"""

FUNCTIONS = f"""functions AS (
  SELECT doc_id, CAST(2 AS BIGINT) AS position, 'method_' || doc_id AS function_name,
         '    def method_' || doc_id || '(self, x):' || chr(10) || '        r\"\"\"' || text || chr(10) || '\"\"\"'
           AS signature_with_docstring
  FROM documents),
short AS (SELECT * FROM functions WHERE len({tokens('signature_with_docstring')}) <= 512),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS function_id FROM short)"""

GENERATIONS = """generations AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, u.text || a.text AS generation
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def truncated(text: str) -> str:
    stops = ["chr(10) || '" + stop[1:] + "'" for stop in STOPS]
    places = ", ".join(f"nullif(instr({text}, {stop}), 0)" for stop in stops)
    return f"CASE WHEN coalesce({places}) IS NULL THEN {text} ELSE substr({text}, 1, least({places}) - 1) END"


def windows(tables: str, threshold: int) -> str:
    """``tables`` gives (side, file_id, text)."""
    return f"""sided AS ({tables}),
cut AS (SELECT side, file_id, unnest({pieces('text')}) AS line, generate_subscripts({pieces('text')}, 1) AS no FROM sided),
filled AS (
  SELECT side, file_id, no, {strip('line')} AS line,
         row_number() OVER (PARTITION BY side, file_id ORDER BY no) AS place,
         count(*) OVER (PARTITION BY side, file_id) AS n_lines
  FROM cut WHERE {strip('line')} <> ''),
spans AS (
  SELECT side, file_id, place, n_lines, no AS start_line,
         md5(string_agg(line, chr(10)) OVER w) AS window_key, last_value(no) OVER w AS end_line
  FROM filled
  WINDOW w AS (PARTITION BY side, file_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {threshold - 1} FOLLOWING)),
keyed AS (
  SELECT *, lag(window_key) OVER f AS before, lead(window_key) OVER f AS after
  FROM spans WHERE place <= n_lines - {threshold - 1}
  WINDOW f AS (PARTITION BY side, file_id ORDER BY place))"""


def clone_blocks(tables: str, threshold: int, two_sides: bool) -> str:
    repeated = "min(side) <> max(side)" if two_sides else "count(*) > 1"
    return f"""{windows(tables, threshold)},
shared_windows AS (
  SELECT window_key, count(after) = count(*) AND count(DISTINCT after) = 1 AS one_after,
         count(before) = count(*) AND count(DISTINCT before) = 1 AS one_before
  FROM keyed GROUP BY window_key HAVING {repeated}),
placed AS (SELECT keyed.*, one_after, one_before FROM keyed JOIN shared_windows USING (window_key)),
marked AS (
  SELECT *, CASE WHEN lag(place) OVER f = place - 1 AND lag(one_after) OVER f AND one_before THEN 0 ELSE 1 END AS starts,
         CASE WHEN lag(place) OVER f = place - 1 THEN 0 ELSE 1 END AS gap
  FROM placed WINDOW f AS (PARTITION BY side, file_id ORDER BY place)),
numbered_runs AS (
  SELECT *, sum(starts) OVER f AS run, sum(gap) OVER f AS island FROM marked
  WINDOW f AS (PARTITION BY side, file_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
runs AS (
  SELECT side, file_id, island, run, min(place) AS first_place, max(place) AS last_place,
         min(start_line) AS start_line, max(end_line) AS end_line, arg_min(window_key, place) AS unit
  FROM numbered_runs GROUP BY ALL),
around AS (
  SELECT unit, coalesce(list(unit) OVER (i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), []) AS after,
         coalesce(list_reverse(list(unit) OVER (i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS before
  FROM runs WINDOW i AS (PARTITION BY side, file_id, island ORDER BY run)),
extremes AS (
  SELECT unit, min(after) AS a1, max(after) AS a2, min(before) AS b1, max(before) AS b2 FROM around GROUP BY unit),
units AS (
  SELECT unit,
         a1[1:len(list_filter(range(1, len(a1) + 1), lambda n: a1[1:n] = a2[1:n]))] AS after,
         b1[1:len(list_filter(range(1, len(b1) + 1), lambda n: b1[1:n] = b2[1:n]))] AS before
  FROM extremes),
grown AS (
  SELECT DISTINCT side, file_id, island, run - len(before) AS run_from, run + len(after) AS run_to
  FROM runs JOIN units USING (unit)),
blocks AS (
  SELECT g.side, g.file_id, x.start_line, y.end_line,
         CAST(y.last_place - x.first_place + {threshold} AS BIGINT) AS line_count,
         (SELECT md5(string_agg(f.line, chr(10) ORDER BY f.no)) FROM filled f
          WHERE f.side = g.side AND f.file_id = g.file_id AND f.no BETWEEN x.start_line AND y.end_line) AS fingerprint
  FROM grown g
  JOIN runs x ON x.side = g.side AND x.file_id = g.file_id AND x.run = g.run_from
  JOIN runs y ON y.side = g.side AND y.file_id = g.file_id AND y.run = g.run_to),
clone_set AS (
  SELECT fingerprint, line_count, count(*) AS n_blocks, count(DISTINCT side || '/' || file_id) AS n_files
  FROM blocks GROUP BY fingerprint, line_count)"""


OWN_BLOCKS = clone_blocks("SELECT '' AS side, doc_id AS file_id, text FROM documents", 6, False)
MEMORIZED = clone_blocks(
    "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM routed) THEN 'training' ELSE 'generated' END AS side, "
    "doc_id AS file_id, text FROM documents",
    6,
    True,
)
TOTALS = (
    "SELECT count(*) AS unique_fingerprints, CAST(coalesce(sum(line_count), 0) AS BIGINT) AS sum_of_lines "
    "FROM clone_set WHERE n_files > 1"
)

SPLIT = f"""split AS (
  SELECT {{key}} AS doc_id, CASE WHEN row_number() OVER (ORDER BY {order_hash('{key}', 1)})
           <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM {{table}})"""

CORPUS = f"""{ROUTED}, {SPLIT.format(key='doc_id', table='routed')},
corpus AS (
  SELECT routed.doc_id, org, split, {words('content')} AS words FROM routed JOIN split USING (doc_id)),
grams AS (
  SELECT doc_id, org, split, words[i] AS context, words[i + 1] AS word
  FROM (SELECT *, unnest(range(1, len(words))) AS i FROM corpus)),
model AS (SELECT context, word, count(*) AS n FROM grams WHERE split = 'train' GROUP BY context, word)"""


def packed(source: str, length: int, by: str = "") -> str:
    """``source`` gives (doc_id, tokens) with the separator at the end."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""source AS ({source}),
offsets AS (
  SELECT {cols}tokens, coalesce(sum(len(tokens)) OVER (
    {part}ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM source),
placed_tokens AS (
  SELECT {cols}start + generate_subscripts(tokens, 1) - 1 AS spot, unnest(tokens) AS token FROM offsets),
packed AS (
  SELECT {cols}CAST(spot // {length} AS BIGINT) AS seq_id, string_agg(CAST(token AS VARCHAR), '|' ORDER BY spot) AS tokens
  FROM placed_tokens GROUP BY {cols}spot // {length} HAVING count(*) = {length})"""


def buffered(source: str, measure: str, bound: int, length: int, by: str = "") -> str:
    """As ``packed``, a buffer at a time; ``measure`` is what fills a buffer up to ``bound``. Starts with a recursive table."""
    cols = f"{by}, " if by else ""
    same = f"spans.{by} = starts.{by} AND" if by else ""
    of_by = f"PARTITION BY {by}" if by else ""
    starts_by = f"starts.{by}, " if by else ""
    return f"""source AS ({source}),
spans AS (
  SELECT {cols}doc_id, tokens, {measure} AS size, coalesce(sum({measure}) OVER (
    {of_by} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM source),
starts AS (
  SELECT DISTINCT {cols}0::BIGINT AS start FROM spans
  UNION ALL
  SELECT {starts_by}min(spot + size) FROM starts JOIN spans ON {same} spot + size >= start + {bound}
  GROUP BY {f'starts.{by}' if by else 'start'}),
grouped AS (
  SELECT {f'spans.{by}, ' if by else ''}doc_id, any_value(tokens) AS tokens, max(start) AS buffer
  FROM spans JOIN starts ON {same} start <= spot GROUP BY {f'spans.{by}, ' if by else ''}doc_id),
offsets AS (
  SELECT {cols}buffer, tokens, coalesce(sum(len(tokens)) OVER (
    PARTITION BY {cols}buffer ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM grouped),
placed_tokens AS (
  SELECT {cols}buffer, start + generate_subscripts(tokens, 1) - 1 AS spot, unnest(tokens) AS token FROM offsets),
blocks AS (
  SELECT {cols}buffer, spot // {length} AS block, string_agg(CAST(token AS VARCHAR), '|' ORDER BY spot) AS tokens
  FROM placed_tokens GROUP BY {cols}buffer, spot // {length} HAVING count(*) = {length}),
packed AS (
  SELECT {cols}row_number() OVER ({of_by} ORDER BY buffer, block) - 1 AS seq_id, tokens FROM blocks)"""


TEXT_TOKENS = f"SELECT doc_id, list_append({tokens('text')}, '<|endoftext|>') AS tokens FROM documents"
ID_TOKENS = (
    f"SELECT doc_id, lang, list_append(list_transform({words('text')}, lambda w: {hex_int('w', 7)}), 0) AS tokens "
    "FROM documents"
)



def shuffled_tokens(split: str, seed: int) -> str:
    """The documents of one part of the split, numbered in their seeded order."""
    return (
        f"SELECT row_number() OVER (ORDER BY {order_hash('doc_id', seed)}) - 1 AS doc_id, "
        f"list_append({tokens('text')}, '<|endoftext|>') AS tokens "
        f"FROM documents JOIN split USING (doc_id) WHERE split.split = '{split}'"
    )


BATCHES = """SELECT CAST(seq_id // 2 AS BIGINT) AS batch_id, count(*) AS n_sequences,
               string_agg(tokens, '|' ORDER BY seq_id) AS tokens
        FROM {table} GROUP BY seq_id // 2"""

ORACLE: dict[str, str] = {
    "collect_sources": f"""WITH {RAW},
        files AS (SELECT md5(content) AS id, repo_name, path FROM raw),
        contents AS (
          SELECT md5(content) AS id, count(*) AS copies, max(CAST(size AS BIGINT)) AS size, max(content) AS content,
                 max(CAST(size AS BIGINT)) < 100 AS is_binary
          FROM raw GROUP BY md5(content)),
        licenses AS (
          SELECT DISTINCT repo_name, 'mit' AS license FROM raw
          UNION ALL SELECT DISTINCT repo_name, 'apache-2.0' FROM raw WHERE repo_name LIKE '%/en')
        SELECT f.repo_name, f.path, c.copies, c.size, c.content, l.license
        FROM files f JOIN contents c ON f.id = c.id JOIN licenses l ON f.repo_name = l.repo_name
        WHERE NOT c.is_binary AND f.path LIKE '%.py'""",
    "scan_csv_shards": f"WITH {RAW} SELECT * FROM raw",
    "scan_jsonl": f"WITH {RAW} SELECT * FROM raw",
    "scan_clone_report": f"""WITH {OWN_BLOCKS}
        SELECT fingerprint, line_count, CAST(file_id AS VARCHAR) AS source_file, start_line, end_line FROM blocks""",
    "scan_clone_summary": f"""WITH {OWN_BLOCKS}
        SELECT 'duplicateBlockCount' AS key, CAST(count(*) AS VARCHAR) AS value FROM blocks
        UNION ALL SELECT 'duplicateFileCount', CAST(count(DISTINCT file_id) AS VARCHAR) FROM blocks
        UNION ALL SELECT 'duplicateLineCount', CAST(CAST(sum(line_count) AS BIGINT) AS VARCHAR) FROM blocks""",
    "sink_org_csv": f"WITH {ROUTED} SELECT doc_id, repo_name, path, copies, size, content, org FROM routed",
    "sink_jsonl_gz": "SELECT doc_id, text AS content FROM documents",
    "sink_duplicate_clusters": f"""WITH RECURSIVE {OUTCOME}, {ANNOTATED}
        SELECT cluster_id, id, repo_name, path, is_extreme, coalesce(copies, 0) AS copies,
               count(*) OVER (PARTITION BY cluster_id) AS n_members FROM annotated""",
    "sink_csv_tables": f"""WITH {FUNCTIONS}
        SELECT function_id AS "function id", function_name AS "function name",
               signature_with_docstring AS "signature with docstring" FROM numbered""",
    "union_corpora": f"WITH {ROUTED} SELECT doc_id, org, repo_name, path FROM routed",
    "org_route": f"WITH {ROUTED} SELECT doc_id, repo_name, org FROM routed",
    "cast_size": "SELECT doc_id, n_chars AS size FROM documents",
    "content_hash": f"SELECT doc_id, md5(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS hash FROM documents",
    "line_stats": f"WITH {FEATURES} SELECT doc_id, line_mean, line_max FROM features",
    "alpha_frac": f"WITH {FEATURES} SELECT doc_id, alpha_frac FROM features",
    "char_token_ratio": f"WITH {FEATURES} SELECT doc_id, ratio FROM features",
    "is_autogenerated": f"WITH {FEATURES} SELECT doc_id, autogenerated FROM features",
    "is_config_or_test": f"WITH {FEATURES} SELECT doc_id, config_or_test FROM features",
    "has_no_keywords": f"WITH {FEATURES} SELECT doc_id, has_no_keywords FROM features",
    "has_few_assignments": f"WITH {FEATURES} SELECT doc_id, has_few_assignments FROM features",
    "file_features": f"WITH {FEATURES} SELECT * FROM features",
    "heuristic_filter": f"""WITH {REASONS}
        SELECT doc_id, hash, line_mean, alpha_frac, ratio FROM judged WHERE drop_reason IS NULL""",
    "cleaning_outcome": f"""WITH {REASONS}
        SELECT doc_id, drop_reason IS NULL AS kept, coalesce(drop_reason, 'kept') AS drop_reason FROM judged""",
    "cleaning_outcome_counted": f"""WITH {REASONS.replace(f"len({tokens('text')}) AS ratio", f"len({words('text')}) AS ratio")}
        SELECT doc_id, drop_reason IS NULL AS kept, coalesce(drop_reason, 'kept') AS drop_reason FROM judged""",
    "probabilistic_thin": f"""WITH {FEATURES}
        SELECT doc_id, has_no_keywords AS flag FROM features
        WHERE NOT (has_no_keywords AND {draw('doc_id', 'has_no_keywords', 1)} <= CAST(0.7 AS DOUBLE))""",
    "filter_report": f"""WITH {REASONS}
        SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n_rows FROM judged GROUP BY 1""",
    "filter_report_observed": f"""WITH {REASONS}
        SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n_rows FROM judged GROUP BY 1""",
    "filter_summary": f"""WITH {REASONS}
        SELECT count(*) AS rows_loaded,
               CAST(count(*) FILTER (drop_reason = 'duplicate') AS DOUBLE) / count(*) AS duplicate_fraction,
               count(*) FILTER (drop_reason IS NULL) AS rows_filtered
        FROM judged""",
    "duplicate_fraction": f"""WITH {FEATURES}
        SELECT 1 - CAST(count(DISTINCT hash) AS DOUBLE) / count(*) AS duplicate_fraction FROM features""",
    "exact_dedup": f"""
        SELECT doc_id, content FROM (
          SELECT doc_id, text AS content, row_number() OVER (
            PARTITION BY md5(regexp_replace(text, '[{SPACE}]+', '', 'g')) ORDER BY doc_id) AS rn FROM documents)
        WHERE rn = 1""",
    "token_set": f"""WITH {TOKEN_SETS}
        SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(list_sort(tokens), ' ') AS tokens FROM sets""",
    "minhash_signature": f"""WITH {SIGNATURES}
        SELECT doc_id, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY i) AS signature FROM slots GROUP BY doc_id""",
    "lsh_candidates": f"""WITH {SHARED}
        SELECT DISTINCT x.doc_id AS id_a, y.doc_id AS id_b FROM shared x JOIN shared y USING (bucket) WHERE x.doc_id < y.doc_id""",
    "duplicate_clusters": f"WITH RECURSIVE {COMPONENTS} SELECT cluster_id, id FROM members",
    "duplicate_clusters_stars": f"WITH RECURSIVE {COMPONENTS} SELECT cluster_id, id FROM members",
    "duplicate_clusters_greedy": f"WITH RECURSIVE {GREEDY} SELECT cluster_id, id FROM members",
    "jaccard_similarity": f"""WITH {PAIRS}
        SELECT id_a, id_b, {JACCARD.format(a='x.tokens', b='y.tokens')} AS jaccard
        FROM pairs JOIN sets x ON x.doc_id = id_a JOIN sets y ON y.doc_id = id_b""",
    "similar_pairs": f"""WITH {TOKEN_SETS}, different AS (
          SELECT min(doc_id) AS id, any_value(tokens) AS tokens FROM sets GROUP BY list_sort(tokens))
        SELECT x.id AS id_a, y.id AS id_b, {JACCARD.format(a='x.tokens', b='y.tokens')} AS jaccard
        FROM different x JOIN different y ON x.id < y.id AND len(x.tokens) > 0 AND len(y.tokens) > 0
          AND least(len(x.tokens), len(y.tokens)) >= 0.84 * greatest(len(x.tokens), len(y.tokens))
        WHERE {JACCARD.format(a='x.tokens', b='y.tokens')} >= CAST(0.85 AS DOUBLE)""",
    "similar_pairs_members": f"""WITH {TOKEN_SETS}
        SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY list_sort(tokens)) AS representative FROM sets""",
    "cluster_extremes": f"WITH RECURSIVE {OUTCOME} SELECT cluster_id, id, extreme_id FROM outcome",
    "cluster_extremes_greedy": f"WITH RECURSIVE {OUTCOME_GREEDY} SELECT cluster_id, id, extreme_id FROM outcome",
    "near_dedup": f"""WITH RECURSIVE {OUTCOME}, {REMOVED}
        SELECT doc_id, text AS content FROM documents WHERE doc_id NOT IN (SELECT id FROM removed)""",
    "near_dedup_greedy": f"""WITH RECURSIVE {OUTCOME_GREEDY}, {REMOVED}
        SELECT doc_id, text AS content FROM documents WHERE doc_id NOT IN (SELECT id FROM removed)""",
    "annotate_clusters": f"""WITH RECURSIVE {OUTCOME}, {ANNOTATED}
        SELECT cluster_id, id, repo_name, path, is_extreme, coalesce(copies, 0) AS copies FROM annotated""",
    "near_dedup_stats": f"""WITH RECURSIVE {OUTCOME}, {REMOVED}
        SELECT (SELECT count(*) FROM documents) AS original_rows,
               count(DISTINCT cluster_id) AS n_clusters, count(DISTINCT id) AS files_in_clusters,
               count(DISTINCT extreme_id) AS unique_files,
               (SELECT count(*) FROM documents) - (SELECT count(*) FROM removed) AS rows_kept
        FROM outcome""",
    "near_dedup_observed": f"""WITH RECURSIVE {OUTCOME}, {REMOVED}
        SELECT (SELECT count(*) FROM documents) AS original_rows, count(DISTINCT id) AS files_in_clusters,
               count(DISTINCT extreme_id) AS unique_files,
               (SELECT count(*) FROM documents) - (SELECT count(*) FROM removed) AS rows_kept
        FROM outcome""",
    "org_summary": f"""WITH {ROUTED}
        SELECT org, count(*) AS n_rows, sum(size) / CAST(1048576 AS DOUBLE) AS size_mb FROM routed GROUP BY org""",
    "perplexity": """
        SELECT round(avg(value / 100), 6) AS loss, round(exp(avg(value / 100)), 6) AS perplexity FROM events""",
    "weighted_metric": """
        SELECT round(sum(n * m) / sum(n), 6) AS perplexity
        FROM (SELECT CAST(count(*) AS DOUBLE) AS n, avg(n_chars) AS m FROM documents GROUP BY source)""",
    "function_counts": f"""WITH {FUNCTIONS},
        counted AS (
          SELECT d.doc_id, CAST(2 AS BIGINT) AS n_functions,
                 CAST(CASE WHEN s.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_docstrings
          FROM documents d LEFT JOIN short s ON s.doc_id = d.doc_id)
        SELECT doc_id, n_functions, n_docstrings,
               CAST(sum(n_functions) OVER (ORDER BY doc_id) AS BIGINT) AS total_functions,
               CAST(sum(n_docstrings) OVER (ORDER BY doc_id) AS BIGINT) AS total_docstrings
        FROM counted""",
    "clone_report_reduce": f"WITH {OWN_BLOCKS} SELECT fingerprint, line_count FROM clone_set WHERE n_files > 1",
    "clone_report_totals": f"WITH {OWN_BLOCKS} {TOTALS}",
    "train_valid_split": f"""WITH {SPLIT.format(key='doc_id', table='documents')}
        SELECT d.doc_id, d.text AS content, split.split FROM documents d JOIN split USING (doc_id)""",
    "seeded_shuffle": f"""
        SELECT doc_id, row_number() OVER (ORDER BY {order_hash('doc_id', 42)}) - 1 AS position FROM documents""",
    "buffer_shuffle": f"""
        SELECT doc_id, row_number() OVER (
          ORDER BY CAST(doc_id AS DOUBLE) + {draw('doc_id', 'buffer', 42)} * CAST(1000 AS DOUBLE), doc_id) - 1
          AS shuffled_position
        FROM documents""",
    "buffer_shuffle_reservoir": f"""WITH
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents),
        slots AS (
          SELECT *, CASE WHEN position < 100 THEN position
            ELSE CAST(floor({draw('(position - 100)', 'slot', 42)} * CAST(100 AS DOUBLE)) AS BIGINT) END AS slot
          FROM placed),
        followed AS (SELECT *, lead(position) OVER (PARTITION BY slot ORDER BY position) AS following FROM slots)
        SELECT doc_id, position, following - 100 AS shuffled_position FROM followed WHERE following IS NOT NULL
        UNION ALL
        SELECT doc_id, position, max(position) OVER () + 1 - count(*) OVER ()
          + row_number() OVER (ORDER BY {order_hash('position', 42)}) - 1
        FROM followed WHERE following IS NULL""",
    "pack_sequences": f"WITH {packed(TEXT_TOKENS, 1024)} SELECT seq_id, tokens FROM packed",
    "pretokenized_pack": f"WITH {packed(ID_TOKENS, 256, 'lang')} SELECT lang, seq_id, tokens FROM packed",
    "pack_sequences_buffered": f"""WITH RECURSIVE {buffered(
        TEXT_TOKENS.replace(" FROM", ", text FROM"), "length(text)", 14746, 128)} SELECT seq_id, tokens FROM packed""",
    "pretokenized_pack_buffered": f"""WITH RECURSIVE {buffered(ID_TOKENS, "(len(tokens) - 1)", 4096, 256, "lang")}
        SELECT lang, seq_id, tokens FROM packed""",
    "sequence_batches": f"""WITH {packed(TEXT_TOKENS, 128)}
        SELECT CAST(seq_id // 3 AS BIGINT) AS batch_id, count(*) AS n_sequences,
               string_agg(tokens, '|' ORDER BY seq_id) AS tokens
        FROM packed GROUP BY seq_id // 3""",
    "training_batches": f"""WITH {SPLIT.format(key='doc_id', table='documents')}, {packed(shuffled_tokens('train', 1), 512)},
        moved AS (
          SELECT tokens, row_number() OVER (
            ORDER BY CAST(seq_id AS DOUBLE) + {draw('seq_id', 'buffer', 1)} * CAST(1000 AS DOUBLE), seq_id) - 1 AS seq_id
          FROM packed)
        {BATCHES.format(table='moved')}""",
    "evaluation_batches": f"""WITH {SPLIT.format(key='doc_id', table='documents')}, {packed(shuffled_tokens('test', 42), 512)}
        {BATCHES.format(table='packed')}""",
    "running_function_id": f"WITH {FUNCTIONS} SELECT function_id, doc_id, function_name FROM numbered",
    "extract_functions": f"""WITH {FUNCTIONS}
        SELECT doc_id, position, function_name, signature_with_docstring FROM functions""",
    "prompt_token_limit": f"""
        SELECT doc_id, text AS content FROM documents WHERE len({tokens('text')}) <= 512""",
    "prompt_token_limit_counted": f"""
        SELECT doc_id, text AS content FROM documents WHERE len({words('text')}) <= 300""",
    "prompt_expand": f"""WITH {GENERATIONS}
        SELECT conv_id * 1000 + turn AS function_id, copy_id, sample_id, '<|endoftext|>' || {strip('prompt')} AS prompt
        FROM generations CROSS JOIN range(1, 3) AS c(copy_id) CROSS JOIN range(1, 6) AS s(sample_id)""",
    "prompt_expand_first": f"""WITH {GENERATIONS},
        numbered AS (
          SELECT conv_id * 1000 + turn AS function_id, prompt, row_number() OVER (ORDER BY conv_id, turn) AS place
          FROM generations)
        SELECT function_id, copy_id, sample_id, '<|endoftext|>' || {strip('prompt')} AS prompt
        FROM numbered CROSS JOIN range(1, 2) AS c(copy_id) CROSS JOIN range(1, 6) AS s(sample_id)
        WHERE place <= 25""",
    "strip_prompt": f"""WITH {GENERATIONS}
        SELECT conv_id, turn, substr(generation, length(prompt) + 1) AS body FROM generations""",
    "truncate_at_stop": f"SELECT conv_id, turn, {truncated('text')} AS body FROM conversations",
    "number_generations": f"""WITH {GENERATIONS},
        stripped AS (SELECT conv_id, turn, substr(generation, length(prompt) + 1) AS body FROM generations)
        SELECT conv_id AS function_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS generation_id,
               {truncated('body')} AS generated_content
        FROM stripped""",
    "scan_generations": f"""WITH {GENERATIONS},
        stripped AS (SELECT conv_id, turn, substr(generation, length(prompt) + 1) AS body FROM generations)
        SELECT conv_id AS function_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS generation_id,
               coalesce({truncated('body')}, '') AS generated_content
        FROM stripped""",
    "scan_prompts": f"WITH {FUNCTIONS} SELECT function_id, function_name, signature_with_docstring FROM numbered",
    "line_clones": f"""WITH {OWN_BLOCKS}
        SELECT file_id, start_line, end_line, line_count, fingerprint FROM blocks""",
    "clone_sets": f"WITH {OWN_BLOCKS} SELECT fingerprint, line_count, n_blocks, n_files FROM clone_set",
    "memorization_report": f"WITH {ROUTED}, {MEMORIZED} SELECT fingerprint, line_count FROM clone_set WHERE n_files > 1",
    "memorization_totals": f"WITH {ROUTED}, {MEMORIZED} {TOTALS}",
    "ngram_train": f"WITH {CORPUS} SELECT context, word, n FROM model",
    "ngram_perplexity": f"""WITH {CORPUS},
        sizes AS (SELECT count(DISTINCT word) + 1 AS v FROM model),
        contexts AS (SELECT context, sum(n) AS n FROM model GROUP BY context)
        SELECT count(*) AS n_tokens, round(exp(-avg(ln(
                 (coalesce(m.n, 0) + 1) / CAST(coalesce(c.n, 0) + (SELECT v FROM sizes) AS DOUBLE)))), 4) AS perplexity
        FROM grams g
        LEFT JOIN model m ON m.context = g.context AND m.word = g.word
        LEFT JOIN contexts c ON c.context = g.context
        WHERE g.split = 'test'""",
    "ngram_federated": f"""WITH {CORPUS},
        per_org AS (
          SELECT org, count(*) AS examples, sum(greatest(len(words) - 1, 0)) AS n_grams
          FROM corpus WHERE split = 'train' GROUP BY org),
        local_model AS (
          SELECT org, context, word, count(*) AS n FROM grams WHERE split = 'train' GROUP BY ALL)
        SELECT context, word,
               round(sum(CAST(examples AS DOUBLE) * n / n_grams) / (SELECT sum(examples) FROM per_org), 9) AS probability
        FROM local_model JOIN per_org USING (org) GROUP BY context, word""",
    "ngram_incremental": f"""WITH {CORPUS},
        steps(org, step) AS (VALUES {', '.join(f"('{org}', CAST({i} AS BIGINT))" for i, org in enumerate(OWNERS, start=1))})
        SELECT context, word, count(*) AS n, min(step) AS first_step, max(step) AS last_step
        FROM grams JOIN steps USING (org) WHERE split = 'train' GROUP BY context, word""",
    "weighted_vector_mean": """
        SELECT label, position, round(sum(weight * value) / sum(weight), 6) AS value
        FROM (
          SELECT label, CAST(vec_id % 5 + 1 AS DOUBLE) AS weight,
                 CAST(unnest(embedding) AS DOUBLE) AS value, generate_subscripts(embedding, 1) - 1 AS position
          FROM embeddings)
        GROUP BY label, position""",
    "stream_org_route": f"WITH {ROUTED} SELECT doc_id, repo_name, org FROM routed",
    "stream_exact_dedup": f"""
        SELECT md5(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS hash, CAST(1 AS BIGINT) AS n_first
        FROM documents GROUP BY 1""",
    "stream_exact_dedup_known": f"""
        SELECT md5(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS hash, CAST(1 AS BIGINT) AS n_first
        FROM documents GROUP BY 1 HAVING NOT bool_or(coalesce(lang = 'en', false))""",
    "stream_ngram_train": f"""
        SELECT words[i] AS context, words[i + 1] AS word, count(*) AS n
        FROM (SELECT words, unnest(range(1, len(words))) AS i FROM (SELECT {words('text')} AS words FROM documents))
        GROUP BY 1, 2""",
}
