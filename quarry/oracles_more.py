"""SQL for the queries of `registry_more.py`."""

from __future__ import annotations

from quarry.oracles import DOCS, GRID, LANGCHAIN, LLAMAINDEX, NL, PER_QUERY, PROMPT, TEXT_HITS, cleaned, fixed, sentence, stats, term_vectors, token
from quarry.sources.files import SAMPLE

# -- files: x the text with its line ends, u with newlines alone, l the lines as a PDF's pages
FILES = f"""SELECT *, replace(x, chr(13), '') AS u, string_split(replace(x, chr(13), ''), {NL}) AS l FROM (
  SELECT doc_id, ['.txt', '.MD', '.py', '.exe', '.json', '', '.pdf'][doc_id % 7 + 1] AS e, doc_id % 3 = 0 AND doc_id % 7 <> 6 AS odd, CASE WHEN doc_id % 2 = 0 THEN replace(t, {NL}, chr(13) || {NL}) ELSE t END AS x
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)) WHERE e NOT IN ('.exe', '')"""
READ = f"""SELECT *, CASE WHEN e = '.pdf' THEN array_to_string(list_filter(list_transform(l, lambda p, i: CASE WHEN p <> '' THEN '--- Page ' || i || ' ---' || {NL} || p END), lambda p: p IS NOT NULL), {NL} || {NL}) ELSE u END AS content FROM ({FILES})"""
ENCODING = "CASE WHEN e = '.pdf' THEN 'pdf' WHEN odd THEN 'latin-1' ELSE 'utf-8' END"
READ_FILES = f"""SELECT '/in.put/d' || doc_id || e AS path, 'd' || doc_id || e AS name, lower(e) AS extension, (strlen(x) + odd::INTEGER)::BIGINT AS size_bytes, (length(content) - length(replace(content, {NL}, '')) + 1)::INTEGER AS line_count,
  (CASE WHEN odd THEN strlen(content) + 1 ELSE length(content) END)::INTEGER AS char_count, {ENCODING} AS encoding, (CASE WHEN e = '.pdf' THEN len(l) ELSE 0 END)::INTEGER AS page_count,
  CASE WHEN {ENCODING} = 'utf-8' THEN md5(content) END AS text_md5 FROM ({READ})"""

FORMS = f"""SELECT i::INTEGER AS i, unnest([{{'form': 'json', 'export': '{{' || {NL} || '  "strategy": "' || strategy || '",' || {NL} || '  "chunk_size": ' || chunk_size || ',' || {NL} || '  "overlap_percent": 10,' || {NL} || '  "overlap_tokens": ' || overlap_tokens || {NL} || '}}'}},
  {{'form': 'langchain', 'export': {LANGCHAIN}}}, {{'form': 'llamaindex', 'export': {LLAMAINDEX}}}], recursive := true) FROM (VALUES (0, 'token', 200, 20), (1, 'token', 300, 20), (2, 'sentence', 200, 7)) t(i, strategy, chunk_size, overlap_tokens)"""

LINES = f"SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, {NL}) AS p FROM ({DOCS}))"
BLANKED = "SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS text) FROM documents"
CUSTOM = f"""SELECT doc_id, md5(c) AS cleaned_md5, (length(dirty) - length(c))::INTEGER AS removed_chars FROM (
  SELECT *, CASE WHEN regexp_matches(dirty, '\\S') THEN regexp_replace(CASE WHEN starts_with(d, 'T') THEN d ELSE regexp_replace(d, '[1-9]', '0', 'g') END, '^\\s+|\\s+$', '', 'g') ELSE dirty END AS c
  FROM (SELECT doc_id, dirty, {cleaned()} AS d FROM (SELECT doc_id, text AS dirty FROM documents)))"""
HIGHLIGHT = f"""SELECT doc_id, chunk_index, left(text, length(text) - n) AS before, right(text, n) AS overlap FROM (
  SELECT *, CASE WHEN nxt < end_pos AND end_pos - nxt <= length(text) THEN end_pos - nxt ELSE 0 END AS n FROM (SELECT *, lead(start_pos) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nxt FROM ({fixed(200, 20)})))"""
TURNS = "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations"
LETTERS = "length(text)::DOUBLE AS e0, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e1, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS e2, 1.0::DOUBLE AS e3"


def rates(config: int, name: str, size: int, overlap: int, chunks: str) -> str:
    """Hit rate of the stated questions over the chunks of one configuration."""
    return f"""
      SELECT {config} AS config_id, '{name}' AS strategy, {size} AS chunk_size, {overlap} AS overlap_tokens, count(*) AS total_queries, round(avg(top), 3) AS avg_top_score, round(avg(CASE WHEN top >= 0.5 THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS hit_rate FROM (
        WITH ch AS (SELECT doc_id * 16777216 + chunk_index AS chunk_id, text FROM ({chunks})), v AS ({term_vectors("SELECT * FROM ch", "chunk_id")}),
        q AS ({term_vectors("SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0", "query_id")}),
        vn AS (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM v GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM q GROUP BY 1),
        s AS (SELECT q.query_id, v.chunk_id, sum(q.c * v.c) AS dot FROM q JOIN v USING (d) GROUP BY 1, 2)
        SELECT query_id, max(dot / (qn.n * vn.n)) AS top FROM s JOIN qn USING (query_id) JOIN vn USING (chunk_id) GROUP BY 1)"""


RATES = " UNION ALL ".join((rates(0, "sentence", 100, 0, sentence(100, 0)), rates(1, "fixed_chars", 100, 10, fixed(100, 10))))

ORACLES: dict[str, str] = {
    "read_files": READ_FILES,
    "read_pdf": f"SELECT 'd' || doc_id || e AS name, len(l)::INTEGER AS page_count, 'pdf' AS encoding, md5(content) AS text_md5 FROM ({READ}) WHERE e = '.pdf'",
    "read_folder": f"""SELECT n_nationkey::INTEGER AS n_nationkey, content, '.txt' AS extension, strlen(content)::BIGINT AS size_bytes, (length(content) - length(replace(content, {NL}, '')) + 1)::INTEGER AS line_count, length(content)::INTEGER AS char_count,
      'utf-8' AS encoding, 0 AS page_count FROM (SELECT n_nationkey, concat_ws({NL}, n_name, n_regionkey) || {NL} AS content FROM nation)""",
    "errors": """SELECT * FROM (VALUES ('missing file', 'FileNotFoundError'), ('unknown strategy', 'ValueError'), ('overlap as large as the size', 'ValueError'), ('custom without a function', 'ValueError'), ('unknown export', 'ValueError'),
      ('fewer vectors than texts', 'ValueError'), ('vector of another width', 'ValueError'), ('service without embeddings', 'NotImplementedError'), ('status 404', 'HTTPError'), ('unknown file type', 'error of a row'),
      ('too many chunks of a document', 'error of a row')) t(refused, error)""",
    "preset_saved": """SELECT name, 'sentence' AS strategy, size::INTEGER AS chunk_size, 12 AS overlap_percent, 'of my own' AS description, '2020-01-01T00:00:00' AS created_at FROM (VALUES ('My preset?', 322), ('Über-1', 444)) t(name, size)""",
    "preset_load": """SELECT * FROM (VALUES ('📚 LONG documents', 'paragraph', 512, 10), ('My preset!', 'sentence', 322, 12), ('Über-1', 'sentence', 444, 12), ('gone', NULL, NULL, NULL), ('nothing', NULL, NULL, NULL)) t(asked, strategy, chunk_size, overlap_percent)""",
    "preset_delete": "SELECT * FROM (VALUES ('Über-1', 1), ('📚 Long Documents', 0), ('none', 0)) t(name, times)",
    "config_forms": FORMS,
    "config_from_json": f"""SELECT chunk_size AS size_0, overlap_percent AS percent_0, CASE WHEN chunk_size % 100 = 0 THEN 'token' ELSE 'sentence' END AS strategy, CASE WHEN chunk_size % 100 = 0 THEN chunk_size ELSE 200 END AS chunk_size,
      CASE WHEN chunk_size % 100 = 0 THEN overlap_percent ELSE 10 END AS overlap_percent, CASE WHEN chunk_size % 100 = 0 THEN 20 ELSE overlap_tokens END AS overlap_tokens FROM ({GRID})""",
    "clamped_params": "SELECT x::INTEGER AS asked, greatest(least(x, 1000), 50)::INTEGER AS chunk_size, greatest(least(x, 50), 0)::INTEGER AS overlap_percent FROM range(-100, 1301, 25) r(x)",
    "strategy_catalogue": "SELECT s AS type, s AS name, true AS described FROM (SELECT unnest(['token', 'sentence', 'paragraph', 'recursive', 'fixed_chars', 'custom']) AS s)",
    "chunk_registered": f"""SELECT doc_id, (i - 1)::INTEGER AS chunk_index, p[i] AS text, s::INTEGER AS start_pos, (s + length(p[i]))::INTEGER AS end_pos, 'line' AS unit_kind, 1 AS unit_count
      FROM (SELECT *, CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(p[1 : i - 1], {NL})) + 1 END AS s FROM ({LINES}))""",
    "chunk_defaults": f"SELECT doc_id, chunk_index, text, 'token' AS unit_kind, unit_count FROM ({token(200, 20)})",
    "clean_custom": CUSTOM,
    "stats_with_empty": f"""SELECT doc_id, coalesce(total_chunks, 0) AS total_chunks, coalesce(total_characters, 0)::BIGINT AS total_characters, coalesce(avg_chunk_size, 0.0) AS avg_chunk_size, coalesce(min_chunk_size, 0)::INTEGER AS min_chunk_size,
      coalesce(max_chunk_size, 0)::INTEGER AS max_chunk_size, coalesce(total_tokens_est, 0)::BIGINT AS total_tokens_est FROM documents LEFT JOIN ({stats(fixed(200, 20, "SELECT * FROM (" + BLANKED + ") WHERE text IS NOT NULL AND regexp_matches(text, '[^ ]')"))}) USING (doc_id)""",
    "chunk_highlight": HIGHLIGHT,
    "summary_line": f"""SELECT doc_id, total_chunks || ' chunks, ' || floor(total_characters / total_chunks + 0.5)::BIGINT || ' characters on average, ' || format('{{:,}}', total_characters) || ' in all, about ' || total_tokens_est || ' tokens' AS summary
      FROM ({stats(fixed(200, 20))})""",
    "sample_text": "SELECT * FROM (VALUES " + ", ".join(f"(1::BIGINT, {i}, {len(s)}, 1)" for i, s in enumerate(SAMPLE)) + ") t(doc_id, chunk_index, characters, unit_count)",
    "embed_batch": f"SELECT doc_id, {LETTERS} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "embed_in_flight": "SELECT count(*) AS texts, sum(length(text))::BIGINT AS characters, count(*) AS ones FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)",
    "embed_retry": """SELECT problem, f::INTEGER AS failures, (CASE WHEN problem = 'status 404' THEN 1 ELSE least(f + 1, 5) END)::INTEGER AS attempts, (CASE WHEN problem = 'status 404' THEN 0 ELSE pow(2, least(f, 4)) - 1 END)::DOUBLE AS paused,
      CASE WHEN problem = 'status 404' THEN f = 0 ELSE f < 5 END AS answered FROM (SELECT unnest(['status 500', 'time-out', 'status 404', 'unforeseen']) AS problem), range(7) r(f)""",
    "embedding_width": "SELECT max(len(embedding))::INTEGER AS width, 'ValueError' AS mixed FROM embeddings",
    "embedding_cache": "SELECT * FROM (VALUES (0, 'a', false, 1), (1, 'b', false, 2), (2, 'c', false, 3), (3, 'a', true, 3), (4, 'd', false, 3), (5, 'e', false, 3), (6, 'a', true, 3), (7, 'b', false, 3)) t(i, text, known, kept)",
    "index_rewrite": f"SELECT 0 AS config_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM ({fixed(200, 20)}) UNION ALL SELECT 1, count(*), sum(length(text))::BIGINT FROM ({token(100, 10)})",
    "vector_store": """SELECT chunk_id::BIGINT AS chunk_id, chunk_index::INTEGER AS chunk_index, text, chunk_id::VARCHAR AS own_id, page FROM (
      SELECT * FROM (VALUES (0, 0, 'first', '3'), (1, 1, 'second', NULL)) t(chunk_id, chunk_index, text, page) UNION ALL SELECT row_number() OVER (ORDER BY vec_id) + 1, vec_id % 3, 'label ' || label, NULL FROM embeddings)""",
    "vector_store_stats": "SELECT count(*) + 2 AS chunks, max(len(embedding))::INTEGER AS dimensions, ((count(*) + 2) * 4 * max(len(embedding)))::BIGINT AS vector_bytes, 3::BIGINT AS hits, 0::BIGINT AS after_clear FROM embeddings",
    "approximate_recall": "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0",
    "batch_matches": f"SELECT query_id, (rank - 1)::INTEGER AS pos, substr(text, 1, 100) AS text, similarity AS score FROM ({TEXT_HITS})",
    "batch_document": f"""SELECT count(*) OVER () AS total_queries, round(avg(top_score) OVER (), 4) AS avg_top_score, round(avg(avg_score) OVER (), 4) AS avg_retrieval_score, round(avg(CASE WHEN top_score >= 0.5 THEN 1.0 ELSE 0.0 END) OVER (), 4)::DOUBLE AS hit_rate,
      'vector ' || query_id AS query, round(top_score::DECIMAL(12, 5), 4)::DOUBLE AS top_score, avg_score, chunks_count FROM ({PER_QUERY})""",
    "hit_rate_grade": "SELECT p::INTEGER AS percent, CASE WHEN p / 100.0::DOUBLE > 0.8 THEN 'good' WHEN p / 100.0::DOUBLE >= 0.6 THEN 'fair' ELSE 'poor' END AS grade FROM range(101) r(p)",
    "sweep_hit_rates": f"SELECT *, CASE WHEN hit_rate > 0.8 THEN 'good' WHEN hit_rate >= 0.6 THEN 'fair' ELSE 'poor' END AS grade FROM ({RATES})",
    "rag_answers": f"SELECT query_id, CASE WHEN query_id = 40 THEN {NL} || {NL} || 'Error: HTTP status 500' ELSE 'It has ' || length(prompt) || ' characters' END AS answer FROM ({PROMPT})",
    "generate_answers": f"SELECT conv_id, turn, 'It has ' || length(text) || ' characters' AS answer FROM ({TURNS})",
    "streamed_answers": f"SELECT conv_id, turn, text AS ndjson, text AS sse FROM ({TURNS})",
    "client_streams": "SELECT k AS kind, 4 AS pieces, 'It has 8 characters' AS streamed, 'It has 8 characters' AS whole FROM (SELECT unnest(['ollama', 'openai', 'groq']) AS k)",
    "provider_catalogue": """SELECT * FROM (VALUES ('ollama', 768, true, true, true, true), ('openai', 1536, true, true, false, false), ('groq', 0, false, true, false, false), ('google', 768, true, true, false, false))
      t(type, embedding_dim, supports_embedding, supports_llm, answers, best)""",
    "stream_newest_chunks": f"SELECT doc_id, 2::BIGINT AS version, chunk_index, start_pos, end_pos FROM ({fixed(200, 20)})",
    "stream_chunks": f"SELECT doc_id, chunk_index, start_pos, end_pos FROM ({fixed(200, 20)})",
}
