"""SQL that the registered queries are held to. It is written for another engine and
on its own terms: recursion over units where the plans fold, list reduction where
they unroll."""

from __future__ import annotations

NL = "chr(10)"
DOCS = "SELECT * FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')"


def fixed(size: int, overlap: int, source: str = DOCS, keys: str = "doc_id") -> str:
    z, s = 4 * size, 4 * (size - overlap)
    return f"""
      SELECT {keys}, i::INTEGER AS chunk_index, substr(text, i * {s} + 1, {z}) AS text, (i * {s})::INTEGER AS start_pos, least(i * {s} + {z}, n)::INTEGER AS end_pos
      FROM (SELECT *, unnest(range(0, CASE WHEN n <= {z} THEN 1 ELSE 1 + ceil((n - {z}) / {s}.0)::BIGINT END)) AS i
            FROM (SELECT *, length(text) AS n FROM ({source})))"""


def token(size: int, overlap: int, source: str = DOCS) -> str:
    s = size - overlap
    return f"""
      SELECT doc_id, i::INTEGER AS chunk_index, array_to_string(t[i * {s} + 1 : i * {s} + {size}], '') AS text, length(array_to_string(t[1 : i * {s}], ''))::INTEGER AS start_pos,
             length(array_to_string(t[1 : i * {s} + {size}], ''))::INTEGER AS end_pos, len(t[i * {s} + 1 : i * {s} + {size}])::INTEGER AS unit_count
      FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN len(t) <= {size} THEN 1 ELSE 1 + ceil((len(t) - {size}) / {s}.0)::BIGINT END)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '\\s*\\S+|\\s+\\z') AS t FROM ({source})))"""


STRIPPED = "list_filter(list_transform({parts}, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
SENTENCES = STRIPPED.format(parts="string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))")
PARAGRAPHS = STRIPPED.format(parts="string_split_regex(text, '\\n\\s*\\n')")


def packed(units: str, size: int, overlap: int, joiner: str, gap: int, tail: str, source: str = DOCS) -> str:
    """tail: 'longest' or 'last'. One step a unit; a step may emit the chunk before it."""
    z, v = 4 * size, 4 * overlap
    suffix = "list_sum(lens[f + n - k + 1 : f + n])"
    count = f"len(list_filter(range(1, n + 1), lambda k: {suffix} + greatest(k - 2, 0) * {gap} < {v}))" if tail == "longest" else f"CASE WHEN lens[f + n] < {v} THEN 1 ELSE 0 END"
    return f"""
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1)::INTEGER AS chunk_index, body AS text, ep::INTEGER AS start_pos, (ep + length(body))::INTEGER AS end_pos, en::INTEGER AS unit_count
      FROM (
        WITH RECURSIVE u AS (SELECT doc_id, us, list_transform(us, lambda x: length(x)) AS lens FROM (SELECT doc_id, {units} AS us FROM ({source}))),
        s AS (
          SELECT doc_id, us, lens, 0 AS i, 0 AS f, 0 AS n, 0::BIGINT AS c, 0::BIGINT AS p, 0::BIGINT AS w, NULL::INTEGER AS ef, NULL::INTEGER AS en, NULL::BIGINT AS ep FROM u
          UNION ALL
          SELECT doc_id, us, lens, (i + 1)::INTEGER, CASE WHEN fl THEN f + n - t ELSE f END::INTEGER, (m + 1)::INTEGER, CASE WHEN fl THEN tw ELSE c END + x, CASE WHEN fl THEN p + w - tw ELSE p END,
                 CASE WHEN fl THEN tw ELSE w END + x + CASE WHEN m > 0 THEN {gap} ELSE 0 END, CASE WHEN fl THEN f END, CASE WHEN fl THEN n END, CASE WHEN fl THEN p END
          FROM (SELECT *, CASE WHEN fl THEN t ELSE n END AS m, CASE WHEN t > 0 THEN list_sum(lens[f + n - t + 1 : f + n]) + (t - 1) * {gap} ELSE 0 END AS tw
                FROM (SELECT *, CASE WHEN fl THEN {count} ELSE 0 END AS t
                      FROM (SELECT *, lens[i + 1] AS x, n > 0 AND c + lens[i + 1] > {z} AS fl FROM s WHERE i < len(lens))))
        ),
        e AS (SELECT doc_id, us, i AS seq, ef, en, ep FROM s WHERE ef IS NOT NULL UNION ALL SELECT doc_id, us, i + 1, f, n, p FROM s WHERE i = len(lens) AND n > 0)
        SELECT doc_id, seq, en, ep, array_to_string(us[ef + 1 : ef + en], {joiner}) AS body FROM e)"""


def sentence(size: int, overlap: int, source: str = DOCS) -> str:
    return packed(SENTENCES, size, overlap, "' '", 1, "longest", source)


def paragraph(size: int, overlap: int, source: str = DOCS) -> str:
    return packed(PARAGRAPHS, size, overlap, f"{NL} || {NL}", 2, "last", source)


def _levels(x: str, level: int, size: int, stride: int) -> str:
    separators = (f"{NL} || {NL}", NL, "'. '", "' '")
    if level == len(separators):
        return f"CASE WHEN length({x}) > 0 THEN list_transform(range(0, length({x}), {stride}), lambda i: substr({x}, i + 1, {size})) ELSE []::VARCHAR[] END"
    sep, p, a, b = separators[level], f"p{level}", f"a{level}", f"b{level}"
    width = (2, 1, 2, 1)[level]
    part = f"""CASE WHEN length({p}) > {size} THEN {{'o': {_levels(p, level + 1, size, stride)}, 'c': []::VARCHAR[], 'n': 0::BIGINT, 'k': length({p})}}
      ELSE {{'o': []::VARCHAR[], 'c': [{p}], 'n': length({p}) + {width}, 'k': length({p})}} END"""
    full = f"(len({a}.c) > 0 AND {a}.n + {b}.k > {size})"
    merged = f"""{{'o': list_concat(CASE WHEN {full} THEN list_append({a}.o, array_to_string({a}.c, {sep})) ELSE {a}.o END, {b}.o),
      'c': CASE WHEN {full} THEN {b}.c ELSE list_concat({a}.c, {b}.c) END, 'n': CASE WHEN {full} THEN {b}.n ELSE {a}.n + {b}.n END, 'k': {b}.k}}"""
    folded = f"list_reduce(list_transform(string_split({x}, {sep}), lambda {p}: {part}), lambda {a}, {b}: {merged})"
    return f"list_transform([{folded}], lambda r{level}: CASE WHEN len(r{level}.c) > 0 THEN list_append(r{level}.o, array_to_string(r{level}.c, {sep})) ELSE r{level}.o END)[1]"


def recursive(size: int, overlap: int, source: str = DOCS) -> str:
    return f"""
      SELECT doc_id, (i - 1)::INTEGER AS chunk_index, chunk AS text, start_pos::INTEGER AS start_pos, (start_pos + length(chunk))::INTEGER AS end_pos
      FROM (
        WITH RECURSIVE c AS (SELECT doc_id, text, {_levels("text", 0, 4 * size, 4 * (size - overlap))} AS cs FROM ({source})),
        w AS (
          SELECT doc_id, text, cs, 0 AS i, NULL::VARCHAR AS chunk, 0::BIGINT AS start_pos, 0::BIGINT AS pos FROM c
          UNION ALL
          SELECT doc_id, text, cs, i + 1, chunk_, start_, start_ + length(chunk_)
          FROM (SELECT *, cs[i + 1] AS chunk_, CASE WHEN instr(substr(text, pos + 1), cs[i + 1]) > 0 THEN pos + instr(substr(text, pos + 1), cs[i + 1]) - 1 ELSE pos END AS start_ FROM w WHERE i < len(cs))
        )
        SELECT * FROM w WHERE i > 0)"""


def doubled(source: str = "documents") -> str:
    return f"SELECT * REPLACE (replace(text, {NL}, {NL} || {NL}) AS text) FROM {source}"


#: Dirt for the cleaners, the same expression in both dialects.
DIRTY = (
    "replace(replace(text, '. ', concat('. ', ' ', chr(9))), chr(10), CASE doc_id % 4 WHEN 0 THEN concat(chr(13), chr(10)) WHEN 1 THEN concat(chr(10), chr(10), chr(10), chr(10)) "
    "WHEN 2 THEN concat('  ', chr(10), '   Page 12  ', chr(10)) ELSE concat(chr(10), '-----', chr(10)) END)"
)

CLEAN = (
    ("newlines", "regexp_replace({}, '\\r\\n?', chr(10), 'g')"),
    ("newline_runs", "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')"),
    ("line_ends", "array_to_string(list_transform(string_split({}, chr(10)), lambda p: regexp_replace(p, '\\s+$', '')), chr(10))"),
    ("spaces", "regexp_replace({}, '[ \\t]+', ' ', 'g')"),
    ("page_lines", "regexp_replace({}, '(?m)^\\s*Page \\d+\\s*$', '', 'g')"),
    ("rules", "regexp_replace({}, '(?m)^\\s*-{{3,}}\\s*$', '', 'g')"),
)


def cleaned(*steps: str) -> str:
    text = "dirty"
    for name, sql in CLEAN:
        if name in steps or not steps:
            text = sql.format(text)
    return text


def clean_query(*steps: str) -> str:
    done = cleaned(*steps) if steps else f"regexp_replace({cleaned()}, '^\\s+|\\s+$', '', 'g')"
    return f"SELECT doc_id, cleaned, (length(dirty) - length(cleaned))::INTEGER AS removed_chars FROM (SELECT doc_id, dirty, {done} AS cleaned FROM (SELECT doc_id, {DIRTY} AS dirty FROM documents))"


def stats(chunks: str, keys: str = "doc_id") -> str:
    return f"""SELECT {keys}, count(*) AS total_chunks, sum(length(text))::BIGINT AS total_characters, round(avg(length(text)), 4) AS avg_chunk_size, min(length(text))::INTEGER AS min_chunk_size,
      max(length(text))::INTEGER AS max_chunk_size, (sum(length(text)) // 4)::BIGINT AS total_tokens_est FROM ({chunks}) GROUP BY {keys}"""


HITS = """SELECT query_id, rank, chunk_id, similarity FROM (
  SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 5) AS similarity
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) v {where})) WHERE rank <= 5"""
ALL_HITS = HITS.format(where="")
BAND = "CASE WHEN similarity >= 0.8 THEN 'green' WHEN similarity >= 0.5 THEN 'yellow' ELSE 'red' END"
FILLED = "least(greatest(trunc(similarity * 30)::INTEGER, 0), 30)"
PREVIEW = "CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END"
TEXT_HITS = f"SELECT h.*, coalesce(d.text, '') AS text FROM ({ALL_HITS}) h LEFT JOIN documents d ON d.doc_id = h.chunk_id"
PER_QUERY = f"SELECT query_id, max(similarity) AS top_score, round(avg(similarity), 4) AS avg_score, count(*)::INTEGER AS chunks_count FROM ({ALL_HITS}) GROUP BY query_id"

SEARCH_CHUNKS = f"SELECT doc_id * 16777216 + chunk_index AS chunk_id, text FROM ({sentence(100, 0)})"


def term_vectors(source: str, key: str) -> str:
    return f"""SELECT {key}, d, count(*)::DOUBLE AS c FROM (
      SELECT {key}, ('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS d FROM (SELECT {key}, unnest(list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda x: x <> '')) AS w FROM ({source}))) GROUP BY ALL"""


SEARCH = f"""
WITH ch AS ({SEARCH_CHUNKS}), v AS ({term_vectors("SELECT * FROM ch", "chunk_id")}), q AS ({term_vectors("SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0", "query_id")}),
vn AS (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM v GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM q GROUP BY 1),
s AS (SELECT q.query_id, v.chunk_id, sum(q.c * v.c) AS dot FROM q JOIN v USING (d) GROUP BY 1, 2),
r AS (SELECT query_id, chunk_id, round(dot / (qn.n * vn.n), 5) AS similarity FROM s JOIN qn USING (query_id) JOIN vn USING (chunk_id))
SELECT query_id, rank, chunk_id, text, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM r) JOIN ch USING (chunk_id) WHERE rank <= 5"""

PROMPT_HITS = f"SELECT query_id, rank, text FROM ({TEXT_HITS}) WHERE rank <= 3"
PROMPT = f"""SELECT query_id, concat('Use the following context to answer the question. If the answer is not in the context, say so.', {NL}, {NL}, 'Context:', {NL},
  string_agg(text, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank), {NL}, {NL}, 'Question: ', 'vector ' || query_id, {NL}, {NL}, 'Answer:') AS prompt FROM ({PROMPT_HITS}) GROUP BY query_id"""
NUMBERED = f"""SELECT query_id, concat('You are a helpful assistant. Answer questions based on the provided context.', {NL}, {NL},
  string_agg('Context ' || rank || ':' || {NL} || text, {NL} || {NL} ORDER BY rank), {NL}, {NL}, 'Question: ', 'vector ' || query_id, {NL}, {NL},
  'Answer based on the context provided above. If the answer cannot be found in the context, say so.') AS prompt FROM ({PROMPT_HITS}) GROUP BY query_id"""

GRID = """SELECT s::INTEGER AS chunk_size, p::INTEGER AS overlap_percent, trunc(s * (p / 100.0::DOUBLE))::INTEGER AS overlap_tokens, trunc(s * p::DOUBLE / 100.0::DOUBLE)::INTEGER AS export_overlap_tokens
  FROM range(50, 1001, 50) a(s), range(0, 51, 5) b(p)"""
LANGCHAIN = """'from langchain_text_splitters import RecursiveCharacterTextSplitter' || chr(10) || chr(10) || '# chunks of about ' || chunk_size || ' tokens' || chr(10)
  || 'splitter = RecursiveCharacterTextSplitter(chunk_size=' || chunk_size * 4 || ', chunk_overlap=' || overlap_tokens * 4 || ')' || chr(10)"""
LLAMAINDEX = """'from llama_index.core.node_parser import SentenceSplitter' || chr(10) || chr(10) || 'parser = SentenceSplitter(chunk_size=' || chunk_size * 4 || ', chunk_overlap=' || overlap_tokens * 4 || ')' || chr(10)"""
EXPORT = f"""SELECT chunk_size, overlap_percent, '{{"strategy":"token","chunk_size":' || chunk_size || ',"overlap_percent":' || overlap_percent || ',"overlap_tokens":' || overlap_tokens || '}}' AS json,
  {LANGCHAIN} AS langchain, {LLAMAINDEX} AS llamaindex FROM ({GRID})"""

SWEEP = " UNION ALL ".join(
    f"SELECT {i} AS config_id, '{name}' AS strategy, {size} AS chunk_size, {overlap} AS overlap_tokens, text FROM ({sql(size, overlap)})"
    for i, (name, size, overlap, sql) in enumerate((("fixed_chars", 100, 10, fixed), ("fixed_chars", 200, 20, fixed), ("token", 100, 10, token), ("sentence", 100, 0, sentence)))
)

ORACLES: dict[str, str] = {
    "chunk_fixed": fixed(200, 20),
    "chunk_fixed_no_overlap": fixed(100, 0),
    "chunk_token": token(100, 10),
    "chunk_sentence": sentence(100, 0),
    "chunk_sentence_overlap": sentence(100, 50),
    "chunk_paragraph": paragraph(200, 0, doubled()),
    "chunk_paragraph_overlap": paragraph(200, 100, doubled()),
    "chunk_recursive": recursive(200, 20),
    "chunk_custom_headers": f"""SELECT doc_id, (i - 1)::INTEGER AS chunk_index, parts[i] AS text, start_pos, (start_pos + length(parts[i]))::INTEGER AS end_pos
      FROM (SELECT *, CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(parts[1 : i - 1], {NL} || '# ')) + 3 END::INTEGER AS start_pos
            FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, {NL}, {NL} || '# '), {NL} || '# ') AS parts FROM ({DOCS}))))""",
    "chunk_stats": stats(fixed(200, 20)),
    "chunk_stats_by_lang": stats(fixed(200, 20, keys="doc_id, lang"), "lang"),
    "chunk_overlap_next": f"""SELECT doc_id, chunk_index, (length(text) // 4)::BIGINT AS token_estimate, overlap_text, length(overlap_text)::INTEGER AS overlap_chars, length(overlap_text) > 0 AS links_next
      FROM (SELECT *, CASE WHEN nxt < end_pos AND end_pos - nxt <= length(text) THEN right(text, end_pos - nxt) ELSE '' END AS overlap_text FROM (SELECT *, lead(start_pos) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nxt FROM ({fixed(200, 20)})))""",
    "chunk_quality": f"""SELECT doc_id, chunk_index, ending, length_flag, starts_lower, concat_ws(' ', ending, length_flag, CASE WHEN starts_lower THEN 'CUT' END) AS indicators, (chunk_index % 6)::INTEGER AS palette
      FROM (SELECT *, CASE WHEN regexp_matches(text, '[.!?]\\s*\\z') THEN 'complete' WHEN regexp_matches(text, '[,:;]\\s*\\z') THEN 'midphrase' ELSE 'cut' END AS ending,
                   CASE WHEN length(text) // 4 < 50 THEN 'SHORT' WHEN length(text) // 4 > 600 THEN 'LONG' END AS length_flag, regexp_matches(text, '^\\s*\\p{{Ll}}') AS starts_lower FROM ({sentence(100, 0)}))""",
    "recommend_params": """SELECT doc_id, CASE WHEN n = 0 THEN NULL WHEN n // 4 < 500 THEN '100-150' WHEN n // 4 < 2000 THEN '200-300' ELSE '300-500' END AS size, CASE WHEN n = 0 THEN NULL WHEN n // 4 < 500 THEN '15-20%' ELSE '10-15%' END AS overlap,
      CASE WHEN n = 0 THEN NULL WHEN n // 4 < 500 THEN '3-5' WHEN n // 4 < 2000 THEN '8-15' ELSE '15+' END AS expected_chunks,
      CASE WHEN n = 0 THEN 'no text yet: nothing to go by' WHEN n // 4 < 500 THEN 'short text: keep chunks narrow' WHEN n // 4 < 2000 THEN 'middling text: neither narrow nor wide' ELSE 'long text: wider chunks cost less' END AS tip
      FROM (SELECT doc_id, length(text) AS n FROM documents)""",
    "clean_newlines": clean_query("newlines", "newline_runs", "line_ends"),
    "clean_spaces": clean_query("spaces"),
    "clean_artifacts": clean_query("page_lines", "rules"),
    "quick_clean": clean_query(),
    "file_info": f"SELECT page_id, strlen(html)::BIGINT AS size_bytes, (length(html) - length(replace(html, {NL}, '')) + 1)::INTEGER AS line_count, length(html)::INTEGER AS char_count FROM pages",
    "file_preview": f"SELECT doc_id, CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], {NL}) || {NL} || '... (' || (len(l) - 3) || ' more lines)' ELSE text END AS preview FROM (SELECT doc_id, text, string_split(text, {NL}) AS l FROM documents)",
    "format_size": "SELECT k::INTEGER AS k, CASE WHEN k < 10 THEN printf('%.1f B', x) WHEN k < 20 THEN printf('%.1f KB', x / 1024) WHEN k < 30 THEN printf('%.1f MB', x / 1048576) WHEN k < 40 THEN printf('%.1f GB', x / 1073741824) ELSE printf('%.1f TB', x / 1099511627776) END AS size FROM (SELECT k, pow(2, k) AS x FROM range(0, 45) r(k))",
    "query_list_parse": f"SELECT page_id, (i - 1)::INTEGER AS pos, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS query FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, string_split(replace(html, '>', '>' || {NL}), {NL}) AS l FROM pages)) WHERE regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') <> ''",
    "vector_topk": ALL_HITS,
    "vector_topk_same_label": HITS.format(where="WHERE q.label = v.label"),
    "similarity_band": f"SELECT query_id, rank, chunk_id, similarity, {FILLED} AS filled, {BAND} AS band, repeat('#', {FILLED}) || repeat('-', 30 - {FILLED}) AS bar FROM ({ALL_HITS})",
    "result_card": f"SELECT query_id, rank, chunk_id, {BAND} AS band, {PREVIEW} AS preview FROM ({TEXT_HITS})",
    "batch_per_query": PER_QUERY,
    "batch_metrics": f"SELECT count(*) AS total_queries, round(avg(top_score), 4) AS avg_top_score, round(avg(avg_score), 4) AS avg_retrieval_score, round(avg(CASE WHEN top_score >= 0.5 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS hit_rate FROM ({PER_QUERY})",
    "batch_report": f"""SELECT row_number() OVER (ORDER BY query_id)::INTEGER AS position, CASE WHEN top_score > 0.5 THEN 'hit' ELSE 'miss' END AS status, 'vector ' || query_id AS query, top_score, avg_score,
      replace(substr(m, 1, 60), {NL}, ' ') AS best_match FROM (SELECT query_id, max(similarity) AS top_score, round(avg(similarity), 4) AS avg_score, substr(arg_min(text, rank), 1, 100) AS m FROM ({TEXT_HITS}) GROUP BY query_id ORDER BY query_id LIMIT 10)""",
    "search_text": SEARCH,
    "embed_dedupe": f"SELECT d.doc_id, 64 AS dimensions, coalesce(round(s, 4), 0.0) AS total FROM documents d LEFT JOIN (SELECT doc_id, sum(c) / sqrt(sum(c * c)) AS s FROM ({term_vectors('SELECT doc_id, text FROM documents', 'doc_id')}) GROUP BY 1) USING (doc_id)",
    "prompt_build": PROMPT,
    "prompt_numbered": NUMBERED,
    "chat_history": f"SELECT conv_id, count(*)::INTEGER AS messages, string_agg(role || ': ' || text, {NL} ORDER BY turn) AS history FROM conversations GROUP BY conv_id",
    "config_export": EXPORT,
    "overlap_tokens_grid": GRID,
    "preset_list": """SELECT * FROM (VALUES (0, 'token', 256, 10), (1, 'token', 128, 15), (2, 'paragraph', 512, 10), (3, 'recursive', 400, 20), (4, 'sentence', 300, 25), (5, 'token', 100, 30), (6, 'paragraph', 800, 5), (7, 'sentence', 150, 20))
      t(position, strategy, chunk_size, overlap_percent)""",
    "sweep_stats": stats(SWEEP, "config_id, strategy, chunk_size, overlap_tokens"),
    "sweep_rollup": f"SELECT strategy, chunk_size, count(*) AS total_chunks, sum(length(text))::BIGINT AS total_characters FROM ({SWEEP}) GROUP BY ROLLUP (strategy, chunk_size)",
}
