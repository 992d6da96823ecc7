"""SQL statements for DuckDB that state the results of ``lodestone.queries`` independently."""

from __future__ import annotations

from types import SimpleNamespace

# Fixed values, stated here once more so that the statements do not depend on the code they check.
settings = SimpleNamespace(
    CHUNK_SIZE=800, CHUNK_OVERLAP=100, TOP_K=5, SIMILARITY_THRESHOLD=0.3, HASH_MODEL="token-hash-md5",
    UNSAFE_PHRASES=(
        "ignore previous instructions", "forget everything", "new instructions:", "system prompt", "you are now", "roleplay as",
        "pretend to be", "act as if", "disregard", "override"),
    REFUSAL_PHRASES=(
        "I don't have enough information", "The crawled content doesn't contain", "Not found in crawled content"),
    ANSWER_NOT_FOUND="I don't have enough information in the crawled content to answer this question.",
    ANSWER_INSUFFICIENT="The crawled content doesn't contain sufficient information about this topic.",
    ANSWER_UNSAFE="I cannot process this request due to safety concerns.",
    ANSWER_PREFIX="Based on the crawled content: ",
    DEFINITION_WORDS=("what is", "what are", "define"),
    EXPLANATION_WORDS=("how", "why", "when", "where"),
)
_INDENT = "\n" + " " * 8
_PROMPT_HEAD = _INDENT + _INDENT.join((
    "You are a helpful assistant that answers strictly based on the provided context.",
    "If the context does not have enough information to answer the question, respond with:",
    f'"{settings.ANSWER_NOT_FOUND}"')) + "\n" + _INDENT + "Context:" + _INDENT
_PROMPT_MID = "\n" + _INDENT + "Question: "
_PROMPT_TAIL = "\n" + _INDENT + "Answer:" + _INDENT
_PROMPT_LENGTH = f"{len(_PROMPT_HEAD + _PROMPT_MID + _PROMPT_TAIL)} + length(context) + length(question)"
_SPACES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LINK_STEPS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 1)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_WS = _text("".join(map(chr, _SPACES)))
_WS_CLASS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url, group):
    return f"regexp_extract({url}, '{_SPLIT}', {group})"


def _domain(url):
    return f"regexp_replace(split_part(lower({_part(url, 2)}), ':', 1), '^www\\.', '')"


def _path(url):
    return f"regexp_replace({_part(url, 3)}, ';[^/]*$', '')"


def _normalized(url):
    query = _part(url, 4)
    return (f"lower({_part(url, 1)}) || '://' || {_part(url, 2)} || {_path(url)} || "
            f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END")


def _crawlable(url):
    return (f"(starts_with({url}, 'http://') OR starts_with({url}, 'https://')) AND NOT regexp_matches(lower({url}), "
            r"'\.(pdf|doc|docx|zip|jpg|png|gif)$')")


def _cleaned(text):
    out = f"regexp_replace({text}, '{_WS_CLASS}', ' ', 'g')"
    for pattern in (  # fixed values: boilerplate runs
            "Cookie\\s+Policy.*?Accept", "Privacy\\s+Policy.*?Terms", "Subscribe\\s+to.*?Newsletter"):
        out = f"regexp_replace({out}, '{pattern}', '', 'gi')"
    return f"trim(regexp_replace({out}, '^(Home|About|Contact|Menu|Navigation)(\\s|$)', '', 'i'))"


def _snippet(text):
    return f"CASE WHEN length({text}) > 200 THEN substring({text}, 1, 200) || '...' ELSE {text} END"


# --- documents and chunks ---------------------------------------------------

_GOOD = f"length(trim(text, {_WS})) >= 50"
_URL = "'doc://' || source || '/' || doc_id"


_DOCUMENTS = f"SELECT doc_id, {_URL} AS url, lang, text FROM documents"


def _chunks(size=settings.CHUNK_SIZE, overlap=settings.CHUNK_OVERLAP, rows=_DOCUMENTS):
    """CTEs ending in ``chunks(doc_id, url, chunk_index, content, src_start)``."""
    space = f"strpos(reverse(substring(d.text, w.a + 1, {size})), ' ')"
    back = f"CAST({size} - {space} AS BIGINT)"
    return f"""WITH RECURSIVE docs AS (
  SELECT *, length(text) AS n FROM ({rows}) WHERE {_GOOD}),
starts AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS a FROM docs WHERE n > {size}
  UNION ALL
  SELECT doc_id, b - {overlap} FROM (
    SELECT w.doc_id, d.n, CASE WHEN w.a + {size} < d.n AND {space} > 0 AND {back} > {overlap}
      THEN w.a + {back} ELSE w.a + {size} END AS b
    FROM starts w JOIN docs d USING (doc_id)) WHERE b - {overlap} < n),
windows AS (
  SELECT w.doc_id, w.a, substring(d.text, w.a + 1, CASE WHEN w.a + {size} < d.n AND {space} > 0
    AND {back} > {overlap} THEN {back} ELSE {size} END) AS raw
  FROM starts w JOIN docs d USING (doc_id)),
pieces AS (
  SELECT doc_id, a + length(raw) - length(ltrim(raw, {_WS})) AS src_start, trim(raw, {_WS}) AS content, a
  FROM windows WHERE trim(raw, {_WS}) <> ''
  UNION ALL SELECT doc_id, 0, text, 0 FROM docs WHERE n <= {size}),
chunks AS (
  SELECT p.doc_id, d.url, d.lang,
    CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.a) - 1 AS INTEGER) AS chunk_index,
    p.content, CAST(p.src_start AS BIGINT) AS src_start
  FROM pieces p JOIN docs d USING (doc_id))"""


_BUCKETS = """SELECT {key}, bucket, count(*) AS n FROM (
    SELECT {key}, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % 384 AS INTEGER) AS bucket
    FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS token FROM {table})
    WHERE token <> '') GROUP BY ALL"""


def _buckets(key, text, table):
    return _BUCKETS.format(key=key, text=text, table=table)


_BENCHMARK = "SELECT item_id AS q_id, text AS question FROM benchmark"
_TURNS = "SELECT conv_id || '-' || turn AS q_id, text AS question FROM conversations WHERE role = 'user'"


def _hits(questions=_BENCHMARK, k=settings.TOP_K, threshold=settings.SIMILARITY_THRESHOLD, rows=_DOCUMENTS):
    """CTEs ending in ``hits(q_id, rank, doc_id, chunk_index, url, content, score)``."""
    return _chunks(rows=rows) + f""",
questions AS ({questions}),
qb AS ({_buckets('q_id', 'question', 'questions')}),
cb AS ({_buckets('doc_id, chunk_index', 'content', 'chunks')}),
qn AS (SELECT q_id, sum(n * n) AS sq FROM qb GROUP BY 1),
cn AS (SELECT doc_id, chunk_index, sum(n * n) AS sq FROM cb GROUP BY 1, 2),
products AS (
  SELECT q_id, doc_id, chunk_index, sum(qb.n * cb.n) AS product FROM qb JOIN cb USING (bucket) GROUP BY ALL),
scored AS (
  SELECT q_id, doc_id, chunk_index,
    round(CAST(product AS DOUBLE) / sqrt(CAST(qn.sq AS DOUBLE) * CAST(cn.sq AS DOUBLE)), 6) AS score
  FROM products JOIN qn USING (q_id) JOIN cn USING (doc_id, chunk_index)),
hits AS (
  SELECT q_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_index, url, content, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, chunk_index) AS rank
    FROM scored WHERE score >= {threshold}) JOIN chunks USING (doc_id, chunk_index) WHERE rank <= {k})"""


# --- contexts and answers ---------------------------------------------------

_PARTS = """, parts AS (
  SELECT *, 'Source: ' || url || chr(10) AS src,
    'Source: ' || url || chr(10) || 'Content: ' || content || chr(10) || chr(10) AS whole FROM hits),
sums AS (SELECT *, sum(length(whole)) OVER (PARTITION BY q_id ORDER BY rank) AS total FROM parts),
fitted AS (
  SELECT q_id, rank, CASE WHEN total <= 4000 THEN whole
    WHEN total - length(whole) <= 4000 AND 4000 - (total - length(whole)) - length(src) - 20 > 100
    THEN src || 'Content: ' || substring(content, 1, CAST(4000 - (total - length(whole)) - length(src) - 20 AS BIGINT))
      || '...' || chr(10) || chr(10) END AS part FROM sums),
contexts AS (SELECT q_id, string_agg(part, '' ORDER BY rank) AS context FROM fitted WHERE part IS NOT NULL GROUP BY 1)"""


def _unsafe(text):
    cases = " ".join(f"WHEN contains({text}, {_text(p)}) THEN {_text(p)}" for p in settings.UNSAFE_PHRASES)
    return f"CASE {cases} END"


def _refusal(answer):
    return " OR ".join(f"contains({answer}, {_text(p)})" for p in settings.REFUSAL_PHRASES)


def _extractive(question, context):
    lines = f"list_filter(string_split({context}, chr(10)), lambda l: starts_with(l, 'Content:'))"
    sentences = (f"list_filter(list_transform(flatten(list_transform({lines}, lambda l: "
                 f"string_split(substring(l, 9), '.'))), lambda s: trim(s, {_WS})), lambda s: s <> '')")

    def asks(words):
        return " OR ".join(f"contains(lower({question}), '{w}')" for w in words)

    count = (f"CASE WHEN {asks(settings.DEFINITION_WORDS)} THEN 3 "
             f"WHEN {asks(settings.EXPLANATION_WORDS)} THEN 4 ELSE 3 END")
    joined = f"(array_to_string(({sentences})[1:{count}], '. ') || '.')"
    capped = f"CASE WHEN length({joined}) > 1000 THEN substring({joined}, 1, 997) || '...' ELSE {joined} END"
    return (f"CASE WHEN trim({context}, {_WS}) = '' THEN {_text(settings.ANSWER_NOT_FOUND)} "
            f"WHEN len({sentences}) = 0 THEN {_text(settings.ANSWER_INSUFFICIENT)} "
            f"ELSE {_text(settings.ANSWER_PREFIX)} || {capped} END")


def _answers(threshold, questions=_BENCHMARK, rows=_DOCUMENTS, answer=None):
    unsafe = _unsafe("lower(question || ' ' || context)")
    answer = answer or _extractive("question", "context")
    return _hits(questions, threshold=threshold, rows=rows) + _PARTS + f""",
asked AS (
  SELECT q_id, question, coalesce(context, '') AS context,
    (SELECT count(*) FROM hits h WHERE h.q_id = q.q_id) AS found
  FROM questions q LEFT JOIN contexts USING (q_id)),
screened AS (SELECT *, {unsafe} IS NOT NULL AS unsafe FROM asked),
answered AS (
  SELECT *, CASE WHEN unsafe THEN {_text(settings.ANSWER_UNSAFE)} ELSE {answer} END AS answer
  FROM screened)
SELECT q_id, answer, CAST(CASE WHEN unsafe THEN 0 ELSE found END AS INTEGER) AS n_sources,
  unsafe OR {_refusal('answer')} AS is_refusal FROM answered"""


# --- pages ------------------------------------------------------------------

def _decoded(text):
    """Entities of the test pages; ``&amp;`` last, so that nothing is decoded twice."""
    out = text
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
                         ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


_PAGE_TEXT = f"""page_text AS (
  SELECT page_id, url, {_cleaned(_decoded("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*>', '', 'g')"))} AS content
  FROM pages)"""

_HREFS = f"""SELECT url AS src_url, CAST(pos - 1 AS INTEGER) AS pos,
    {_part('url', 1)} || '://' || {_part('url', 2)} || href AS raw
  FROM (SELECT url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos
    FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))"""

_RULES = f"""rules AS (
  SELECT domain, seq, prefix, allow FROM (SELECT DISTINCT {_domain('url')} AS domain FROM pages),
    (VALUES (0, '/en/1', true), (1, '/en/', false), (2, '/fr/4', false)) r(seq, prefix, allow)
  WHERE ends_with(domain, '.com'))"""


def _allowed(url):
    query = _part(url, 4)
    path = f"({_part(url, 3)} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    return (f"coalesce((SELECT arg_min(allow, seq) FROM rules WHERE rules.domain = {_domain(url)} "
            f"AND starts_with({path}, rules.prefix)), true)")


def _walk(per_page, use_rules, max_pages, max_depth):
    """CTEs ending in ``seen`` (all visited entries), ``deep`` and ``counts``.

    Budgets are running counts over a walk's whole queue here, unlike the cut-off the engine computes.
    """
    moved = ("regexp_replace(regexp_replace(url, '//[^/?#]*\\.(example\\.[a-z]+)', '//\\1'), '[?#].*$', '') "
             "|| '?id=' || page_id")
    sites = ("SELECT CAST(page_id AS VARCHAR) AS site, url FROM moved" if per_page else
             f"SELECT {_domain('url')} AS site, arg_min(url, page_id) AS url FROM moved GROUP BY 1")
    steps = ", ".join(f"({pos}, {step})" for pos, step in enumerate(LINK_STEPS))
    ctes = [f"moved AS (SELECT page_id, {moved} AS url, html FROM pages)",
            _PAGE_TEXT.replace("FROM pages", "FROM moved"), _RULES.replace("FROM pages", "FROM moved"),
            f"""edges AS (
  SELECT p.url AS src_url, steps.pos, t.url AS dst_url
  FROM moved p, (VALUES {steps}) steps(pos, step), moved t WHERE t.page_id = p.page_id + steps.step
  UNION ALL SELECT url, {len(LINK_STEPS)}, 'https://' || {_part('url', 2)} || '/gone' FROM moved)""",
            f"same AS (SELECT * FROM edges WHERE {_domain('src_url')} = {_domain('dst_url')})",
            f"sites AS ({sites})",
            "f0 AS (SELECT site, url, [0] AS ord FROM sites)",
            "t0 AS (SELECT site, 0 AS done FROM sites)"]
    allowed = _allowed("f.url") if use_rules else "true"
    for d in range(max_depth + 1):
        seen = " UNION ALL ".join(f"SELECT site, url FROM k{i}" for i in range(d + 1))
        ctes += [f"""c{d} AS (
  SELECT f.site, f.url, f.ord, {d} AS depth, CASE WHEN NOT {allowed} THEN 'robots' WHEN p.url IS NULL THEN 'missing'
    WHEN length(p.content) < 100 THEN 'short' ELSE 'accepted' END AS status
  FROM f{d} f LEFT JOIN page_text p ON p.url = f.url)""",
                 f"""k{d} AS (
  SELECT site, url, ord, depth, status FROM (
    SELECT c.*, t.done + coalesce(sum(CASE WHEN status = 'accepted' THEN 1 ELSE 0 END) OVER (
      PARTITION BY site ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM c{d} c JOIN t{d} t USING (site)) WHERE before < {max_pages})""",
                 f"""t{d + 1} AS (
  SELECT t.site, t.done + (SELECT count(*) FROM k{d} k WHERE k.site = t.site AND status = 'accepted') AS done
  FROM t{d} t)""",
                 f"""q{d + 1} AS (
  SELECT k.site, e.dst_url AS url, list_append(k.ord, CAST(e.pos AS INTEGER)) AS ord
  FROM k{d} k JOIN t{d + 1} t USING (site) JOIN same e ON e.src_url = k.url
  WHERE k.status = 'accepted' AND t.done < {max_pages} AND (k.site, e.dst_url) NOT IN ({seen}))""",
                 f"f{d + 1} AS (SELECT site, url, min(ord) AS ord FROM q{d + 1} GROUP BY 1, 2)"]
    ctes.append("seen AS (" + " UNION ALL ".join(f"SELECT * FROM k{d}" for d in range(max_depth + 1)) + ")")
    ctes.append(f"deep AS (SELECT * FROM q{max_depth + 1})")
    ctes.append("""counts AS (
  SELECT s.site, (SELECT count(*) FROM seen v WHERE v.site = s.site AND status = 'accepted') AS page_count,
    (SELECT count(*) FROM seen v WHERE v.site = s.site AND status = 'short')
      + (SELECT count(*) FROM deep v WHERE v.site = s.site) AS skipped_count,
    (SELECT count(*) FROM seen v WHERE v.site = s.site AND status IN ('robots', 'missing')) AS error_count
  FROM sites s)""")
    return "WITH " + ",\n".join(ctes)


# --- statements -------------------------------------------------------------

_UNSAFE_INDEX = "CAST((conv_id + turn) % 12 AS BIGINT) + 1"
_ADDED = (f"coalesce(upper(([{', '.join(_text(p) for p in settings.UNSAFE_PHRASES)}])[{_UNSAFE_INDEX}]), '')")
_QUOTES = (*settings.REFUSAL_PHRASES, settings.REFUSAL_PHRASES[2].lower())
_QUOTED = (f"(text || ' ' || coalesce(([{', '.join(_text(p) for p in _QUOTES)}])"
           "[CAST((conv_id + turn) % 6 AS BIGINT) + 1], ''))")
_WORDS = (*settings.DEFINITION_WORDS, *settings.EXPLANATION_WORDS, "")
_ASKED = (f"coalesce(([{', '.join(_text(w) for w in _WORDS)}])[CAST((conv_id + turn) % 8 AS BIGINT) + 1] "
          "|| ' ' || text, text)")
_HALF = "(length(text) // 2)"
_NOISY = (f"('Menu ' || substring(text, 1, {_HALF}) || ' COOKIE  policy text, accept ' "
          f"|| substring(text, {_HALF} + 1) || ' subscribe to our newsletter' || chr(10))")

_DOT = ("round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)")
_RANKED_VECTORS = f"""SELECT q.vec_id AS q_id, v.vec_id, {_DOT} AS score,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) AS INTEGER) AS rank
  FROM embeddings q, embeddings v"""

_SKIPPED = "'Skipping document with no content: ' || " + _URL

ORACLES = {
    "url_domain": f"SELECT page_id, {_domain('url')} AS domain FROM pages",
    "url_normalize": f"""SELECT page_id, {_normalized('url')} AS normalized, {_crawlable('url')} AS crawlable
FROM pages""",
    "doc_key": f"""SELECT page_id, trim(regexp_replace(regexp_replace(CASE WHEN len(parts) = 0
    THEN replace({_part('url', 2)}, '.', '_') ELSE array_to_string(parts[-2:], '_') END,
    '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_+', '_', 'g'), '_') || '_' || substr(md5(url), 1, 8) || '.json' AS doc_key
FROM (SELECT page_id, url, list_filter(string_split({_path('url')}, '/'),
    lambda p: p <> '' AND p <> 'index.html') AS parts FROM pages)""",
    "same_site": f"""SELECT p.page_id, {_domain('p.url')} = {_domain('n.url')} AS same_site
FROM pages p JOIN pages n ON n.page_id = p.page_id + 1""",
    "site_sizes": f"""SELECT {_domain('url')} AS domain, count(*) AS pages,
  CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS same_site_pairs FROM pages GROUP BY 1""",
    "clean_text": f"SELECT doc_id, {_cleaned('text')} AS cleaned FROM documents",
    "clean_boilerplate": f"SELECT doc_id, {_cleaned(_NOISY)} AS cleaned FROM documents",
    "snippets": f"SELECT doc_id, {_snippet('text')} AS snippet FROM documents",
    "short_docs": f"""SELECT 'index' AS stage, {_URL} AS key, {_SKIPPED} AS message
FROM documents WHERE NOT ({_GOOD})""",
    "doc_error_digest": f"""SELECT 'index' AS stage, {_URL} AS key, {_SKIPPED} AS message,
  greatest((SELECT count(*) FROM documents WHERE NOT ({_GOOD})) - 5, 0) AS more
FROM documents WHERE NOT ({_GOOD}) ORDER BY key LIMIT 5""",
    "doc_stats": f"""SELECT source, count(*) AS docs, avg(length(text)) AS avg_chars,
  count(*) FILTER (NOT ({_GOOD})) AS too_short FROM documents GROUP BY 1""",
    "latest_docs": """SELECT doc_key, ts, source FROM (
  SELECT md5(text) AS doc_key, doc_id AS ts, source,
    row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""",
    "chunks": _chunks() + """
SELECT doc_id AS doc_key, chunk_index, url || '#' || chunk_index AS chunk_id, content FROM chunks""",
    "chunks_small": _chunks(30, 10) + """
SELECT doc_id AS doc_key, chunk_index, content FROM chunks""",
    "chunks_sql": _chunks() + f""",
s AS (SELECT doc_id, chunk_index, {_snippet('content')} AS snippet FROM chunks),
cb AS ({_buckets('doc_id, chunk_index', 'content', 'chunks')}),
sb AS ({_buckets('doc_id, chunk_index', 'snippet', 's')}),
cn AS (SELECT doc_id, chunk_index, sum(n * n) AS sq FROM cb GROUP BY 1, 2),
sn AS (SELECT doc_id, chunk_index, sum(n * n) AS sq FROM sb GROUP BY 1, 2),
p AS (SELECT doc_id, chunk_index, sum(cb.n * sb.n) AS product FROM cb JOIN sb USING (doc_id, chunk_index, bucket) GROUP BY 1, 2)
SELECT doc_id AS doc_key, chunk_index, src_start, src_start + length(content) AS src_end, snippet, split_part(url, '/', 3) AS domain,
  coalesce(round(CAST(product AS DOUBLE) / sqrt(CAST(cn.sq AS DOUBLE) * CAST(sn.sq AS DOUBLE)), 4), 0) AS likeness
FROM chunks JOIN s USING (doc_id, chunk_index) LEFT JOIN p USING (doc_id, chunk_index) LEFT JOIN cn USING (doc_id, chunk_index)
  LEFT JOIN sn USING (doc_id, chunk_index)""",
    "chunk_offsets": _chunks() + """
SELECT doc_id AS doc_key, chunk_index, start_char, start_char + n AS end_char, src_start, src_start + n AS src_end
FROM (SELECT *, length(content) AS n, CAST(coalesce(sum(length(content) - 100) OVER (PARTITION BY doc_id
    ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM chunks)""",
    "chunk_totals": _chunks() + """
SELECT count(*) AS chunks, coalesce(avg(length(content)), 0) AS avg_chars FROM chunks""",
    "hash_embed": f"SELECT doc_id, bucket, CAST(n AS BIGINT) AS n FROM ({_buckets('doc_id', 'text', 'documents')})",
    "index_info": _chunks() + f"""
SELECT count(*) AS vector_count, '{settings.HASH_MODEL}' AS embedding_model, 800 AS chunk_size, 100 AS chunk_overlap
FROM chunks""",
    "index_counts": _chunks() + f"""
SELECT count(*) AS vector_count, (SELECT count(*) FROM documents WHERE NOT ({_GOOD})) AS error_count FROM chunks""",
    "vector_topk": f"SELECT q_id, rank, vec_id, score FROM ({_RANKED_VECTORS}) WHERE rank <= 5",
    "vector_topk_blocks": f"SELECT q_id, rank, vec_id, score FROM ({_RANKED_VECTORS}) WHERE rank <= 5",
    "vector_topk_threshold": f"""SELECT q_id, rank, vec_id, score FROM ({_RANKED_VECTORS})
WHERE score >= 0.3 AND rank <= 1 + q_id % 5""",
    "vector_topk_each": f"SELECT q_id, rank, vec_id, score FROM ({_RANKED_VECTORS}) WHERE rank <= 1 + q_id % 20",
    "vector_topk_edges": f"""SELECT q_id, rank, vec_id, score FROM ({_RANKED_VECTORS}) WHERE q_id % 2 = 0 AND score >= 0.25""",
    "unit_vectors": """SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, round(CAST(x / n AS FLOAT)::DOUBLE, 4) + 0.0 AS x FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS p,
    sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)""",
    "vector_best_score": """SELECT q.vec_id AS q_id, coalesce(max(score) FILTER (score >= 0.3), 0) AS top_similarity
FROM (SELECT q.vec_id, round(list_inner_product(list_reverse(q.embedding::DOUBLE[]), v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v) q GROUP BY 1""",
    "retrieved": _hits() + """
SELECT q_id, rank, doc_id AS doc_key, chunk_index, score FROM hits""",
    "retrieved_turns": _hits(_TURNS, 3) + """
SELECT q_id, rank, doc_id AS doc_key, chunk_index, score FROM hits""",
    "context": _hits() + _PARTS + """
SELECT q_id, context FROM contexts""",
    "sources": _hits() + f"""
SELECT q_id, rank AS number, url, {_snippet('content')} AS snippet, score AS similarity_score FROM hits""",
    "prompts": _hits() + _PARTS + f"""
SELECT q_id, {_text(_PROMPT_HEAD)} || context || {_text(_PROMPT_MID)} || question || {_text(_PROMPT_TAIL)} AS prompt
FROM questions JOIN contexts USING (q_id)""",
    "answers": _answers(settings.SIMILARITY_THRESHOLD),
    "answers_strict": _answers(0.6),
    "unsafe_flags": f"""SELECT conv_id, turn, {_unsafe(f"lower(text || ' ' || {_ADDED})")} AS unsafe_phrase
FROM conversations""",
    "refusals": f"SELECT conv_id, turn, {_refusal(_QUOTED)} AS is_refusal FROM conversations",
    "turn_answers": f"""SELECT conv_id, turn, {_extractive('asked', 'packed')} AS answer FROM (
  SELECT conv_id, turn, {_ASKED} AS asked,
    'Source: x' || chr(10) || 'Content: ' || text || chr(10) || chr(10) AS packed FROM conversations)""",
    "page_titles": f"""SELECT page_id,
  trim({_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, {_WS}) AS title FROM pages""",
    "page_text": f"WITH {_PAGE_TEXT} SELECT page_id, content, CAST(length(content) AS INTEGER) AS content_length FROM page_text",
    "page_errors": f"""WITH {_PAGE_TEXT}, bad AS (SELECT page_id, page_id % 7 IN (1, 3)
    OR page_id % 7 = 2 AND contains(html, '</body>') AS bad FROM pages)
SELECT page_id, NOT bad AS readable, CASE WHEN NOT bad THEN CAST(length(content) AS BIGINT) ELSE -1 END AS chars
FROM bad JOIN page_text USING (page_id)""",
    "links": f"""SELECT src_url, pos, dst_url FROM (
  SELECT src_url, pos, {_normalized('raw')} AS dst_url FROM ({_HREFS})) WHERE {_crawlable('dst_url')}""",
    "robots": f"WITH {_RULES} SELECT page_id, {_allowed('pages.url')} AS allowed FROM pages",
    "walked_pages": _walk(True, False, 50, 3) + """
SELECT site, url, CAST(depth AS INTEGER) AS depth,
  CAST(row_number() OVER (PARTITION BY site ORDER BY depth, ord) AS INTEGER) AS visit_no
FROM seen WHERE status = 'accepted'""",
    "walk_stats": _walk(True, True, 50, 3) + """
SELECT site, page_count, CAST(skipped_count AS BIGINT) AS skipped_count, error_count FROM counts""",
    "walk_summary": _walk(False, True, 50, 3) + """
SELECT site, page_count, CAST(skipped_count AS BIGINT) AS skipped_count, error_count, coalesce((
  SELECT string_agg(url, ' ' ORDER BY depth, ord) FROM seen v WHERE v.site = counts.site AND status = 'accepted'), '')
  AS urls FROM counts""",
    "crawl_report": _walk(False, True, 50, 3) + """, told AS (
  SELECT site, 'error' AS kind, CASE status WHEN 'robots' THEN 'Blocked by robots.txt: ' || url
    ELSE 'Error fetching ' || url || ': page ' || status END AS entry FROM seen WHERE status NOT IN ('accepted', 'short'))
SELECT site, 1.5::DOUBLE AS crawl_timestamp, 'url' AS kind,
  CAST(row_number() OVER (PARTITION BY site ORDER BY depth, ord) AS INTEGER) AS place, url AS entry FROM seen WHERE status = 'accepted'
UNION ALL SELECT site, 1.5, kind, CAST(row_number() OVER (PARTITION BY site ORDER BY entry) AS INTEGER), entry FROM told""",
    "streamed_chunks": _chunks() + """
SELECT CAST(doc_id AS VARCHAR) AS doc_key, chunk_index, content, CAST(coalesce(sum(length(content) - 100) OVER (
    PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  AS start_char FROM chunks""",
    "index_reloaded": " UNION ALL ".join(f"""SELECT {version} AS version, {size} AS chunk_size, * FROM ({_chunks(size, overlap)}
SELECT doc_id AS doc_key, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks GROUP BY 1)"""
                                         for version, size, overlap in ((1, 800, 100), (2, 400, 50))),
    "index_delta": _chunks() + """
SELECT doc_id AS doc_key, chunk_index, content FROM chunks""",
    "streamed_versions": _chunks(rows=f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_URL} AS url, lang, text FROM documents
    UNION ALL SELECT 'upload-' || item_id, 'uploaded://item', '', text FROM benchmark""") + """
SELECT doc_id AS doc_key, chunk_index, content FROM chunks""",
    "streamed_answers": " UNION ALL ".join(f"""SELECT {turn} AS index_version, * FROM (
{_answers(settings.SIMILARITY_THRESHOLD, f"SELECT '{turn}-' || item_id AS q_id, text AS question FROM benchmark", rows)})"""
                                           for turn, rows in ((1, _DOCUMENTS), (2, f"""{_DOCUMENTS}
    UNION ALL SELECT -item_id - 1, 'item://' || item_id, '', text FROM benchmark"""))),
    "read_docs_files": f"""SELECT CASE WHEN doc_id % 10 = 0 THEN '' ELSE {_URL} END AS url,
  CASE WHEN doc_id % 10 = 0 THEN 'load' ELSE lang END AS title,
  CASE WHEN doc_id % 10 = 0 THEN 'Error loading a file: url missing' ELSE md5(text) END AS content,
  CASE WHEN doc_id % 10 = 0 THEN 0 ELSE CAST(length(text) AS INTEGER) END AS content_length FROM documents""",
    "upload_docs": f"""SELECT md5(body) AS content, CAST(length(body) AS INTEGER) AS content_length, count(*) AS files,
  count(*) AS urls, count(*) AS keys
FROM (SELECT trim(text, {_WS}) AS body FROM documents WHERE doc_id % 5 > 1) WHERE body <> '' GROUP BY 1, 2""",
    "upload_errors": f"""SELECT 'upload' AS stage, message, count(*) AS files FROM (
  SELECT CASE WHEN doc_id % 5 = 0 THEN 'Unsupported file type ''.csv''' WHEN doc_id % 5 = 1 OR trim(text, {_WS}) = ''
    THEN 'Uploaded file is empty or could not extract text.' END AS message FROM documents)
WHERE message IS NOT NULL GROUP BY 2""",
    "embedded_by_model": """SELECT doc_id, CAST(p - 1 AS INTEGER) AS pos,
  round(CAST(CASE WHEN n > 0 THEN x / n ELSE 0 END AS FLOAT)::DOUBLE, 4) + 0.0 AS x
FROM (SELECT doc_id, unnest(v) AS x, unnest(range(1, 6)) AS p, sqrt(list_inner_product(v, v)) AS n FROM (
  SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'],
    lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE) AS v FROM documents))""",
    "generated_answers": _answers(0.6, answer=f"""CASE WHEN trim(context, {_WS}) = '' THEN {_text(settings.ANSWER_NOT_FOUND)}
    WHEN ({_PROMPT_LENGTH}) % 3 = 0 THEN {_text(settings.ANSWER_INSUFFICIENT)}
    ELSE 'The prompt has ' || ({_PROMPT_LENGTH}) || ' characters.' END"""),
}
