"""SQL statements for DuckDB that state the results of the registered queries of this subpackage independently."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"
_NOTICES = ("all rights reserved", "privacy policy", "terms of service", "terms of use", "cookie policy",
            "we use cookies", "accept cookies", "enable javascript", "lorem ipsum", "click here to", "read more",
            "sign up for", "log in to", "subscribe to our", "share this", "follow us on", "powered by", "back to top",
            "skip to content")
_NOTICE = " OR ".join(f"contains(lower(line), '{x}')" for x in _NOTICES)

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
n AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
win AS (SELECT r, p, array_to_string(list_slice(w, p, p + 4), chr(31)) AS five FROM n),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, five) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p + i) AS n_repeat_words FROM twice, range(5) AS t(i) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lined AS (SELECT r, line, len(regexp_extract_all(line, '[^ \t-\r]+')) AS k,
    len(line) - len(replace(line, '|', '')) AS bars, len(line) - len(replace(line, '!!', '!')) AS shouts,
    len(regexp_extract_all(line, '[#*$%&<>]')) AS marks,
    len(array_to_string(regexp_extract_all(line, '[^ \t-\r]+'), '')) AS chars FROM line),
judged AS (SELECT *, k > 0 AND ((k <= 20 AND ({_NOTICE})) OR (bars > 0 AND bars * 3 >= k - bars)
    OR (shouts > 0 AND shouts * 2 >= k) OR marks * 2 >= k
    OR (k < 4 AND NOT regexp_matches(line, '[.!?:;…。！？؟।]["''”’»)\]]*[ \t-\r]*$'))) AS gone FROM lined),
lost AS (SELECT r, count(*) FILTER (gone) AS n_lines_removed, coalesce(sum(chars) FILTER (gone), 0) AS lost_chars,
    count(*) FILTER (k > 0) - count(DISTINCT line) FILTER (k > 0) AS n_dup_lines FROM judged GROUP BY r),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lines_removed::BIGINT AS n_lines_removed,
    lost_chars::BIGINT AS lost_chars
    FROM d JOIN lost USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept,
    n_lines_removed, lost_chars
FROM c"""

_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2 = rf"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS run
    FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
runs AS (SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS run
    FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT r, k, p, item FROM runs JOIN win USING (k, run)),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

def _base32(digest: str) -> str:
    """Forty hex digits as 32 digits of five bits."""
    part = lambda i: f"('0x' || substr({digest}, {1 + 10 * (i // 8)}, 10))::BIGINT"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({part(i)} >> {35 - 5 * (i % 8)}) & 31)::INT, 1)"
                       for i in range(32))


OP6 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages)
SELECT page_id, payload_bytes, {_base32('hex')} AS payload_digest,
    CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to, 1::BIGINT AS n_requests, 1::BIGINT AS n_metadata
FROM p"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH piece AS (SELECT lang, regexp_extract_all(s, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
run AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
    FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM piece, range(1, 5) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM run GROUP BY ALL),
size AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT lang, k, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') AS head, array_to_string(list_slice(w, c + 1, k), ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT cut.lang, cut.phrase, cut.a, c, h.a AS l, t.a AS r, ((2000000::HUGEINT * cut.a) // (h.a + t.a))::BIGINT AS score
    FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head JOIN f t ON t.lang = cut.lang AND t.phrase = tail),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_run AS (SELECT lang, a, k, w, unnest(range(1, k + 1)) AS i FROM cand),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS longest
    FROM inner_run, range(2, 4) AS t(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT lang, phrase, a, l, r, score FROM least_cut LEFT JOIN inside USING (lang, phrase)
    WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN size USING (lang) QUALIFY rank <= 2000"""

OP13 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
    sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

ORACLES = {
    "op11_collocations": OP11,
    "op13_exact_dedup": OP13,
    "op6_warc": OP6,
    "op2_decontamination": OP2,
    "op10_quality_rules": OP10,
}
