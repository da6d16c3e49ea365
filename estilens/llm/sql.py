"""The text queries in DuckDB SQL, where SQL can express them."""

from estilens.llm.licenses import TEMPLATES

ORACLES: dict[str, str] = {}

# --- quality rules -------------------------------------------------------------------

ORACLES["op1_quality_rules"] = """
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), starts AS (
  SELECT d, i, array_to_string(words[i:i + 4], ' ') AS run
  FROM (SELECT d, words, unnest(generate_series(1, len(words) - 4)) AS i FROM d WHERE len(words) >= 5)
), again AS (SELECT d, i FROM starts QUALIFY count(*) OVER (PARTITION BY d, run) > 1),
repeated AS (SELECT d, count(DISTINCT i) AS n FROM (SELECT d, unnest(generate_series(i, i + 4)) AS i FROM again) GROUP BY d),
each_line AS (
  SELECT d, k, lines[k] AS line, len(regexp_extract_all(lines[k], '[^\\x20\\x09-\\x0D]+')) AS n,
    row_number() OVER (PARTITION BY d, lines[k] ORDER BY k) AS copy
  FROM (SELECT d, lines, unnest(generate_series(1, len(lines))) AS k FROM d)
), passed AS (
  SELECT d, sum(length(line) + 1) - 1 AS n_chars FROM each_line
  WHERE copy = 1 AND 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) <= n
    AND 10 * len(regexp_extract_all(line, '[!?]{2,}')) <= n
    AND (n >= 5 OR regexp_matches(line, '[.!?:;…。]'))
    AND NOT regexp_matches(line, '(?i)all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|click here|sign up for our newsletter|skip to content|lorem ipsum')
  GROUP BY d
), counted AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(array_to_string(lines, chr(10))) AS before, coalesce(passed.n_chars, 0) AS after
  FROM d LEFT JOIN repeated USING (d) LEFT JOIN passed USING (d)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND before - after <= 0.3 * before AS kept,
  n_lines::BIGINT AS n_lines, (before - after)::BIGINT AS n_lost_chars
FROM counted"""

# --- WARC fixity ---------------------------------------------------------------------

_ID = "md5(coalesce(url, '') || coalesce(html, ''))"
ORACLES["op2_warc_fixity"] = f"""
WITH named AS (
  SELECT page_id, 'part-' || coalesce((page_id // 512)::VARCHAR, '-1') || '.warc' AS file, {_ID} AS record,
    coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), records AS (
  SELECT page_id, file, record, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:uuid:' || record[1:8] || '-' || record[9:12] || '-' || record[13:16] || '-' || record[17:20] || '-' || record[21:32]
    || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS body
  FROM named
), sizes AS (SELECT file, record, min(page_id) AS page_id, sum(strlen(body)) AS size FROM records GROUP BY file, record),
places AS (
  SELECT file, record, coalesce(sum(size) OVER (PARTITION BY file ORDER BY page_id, record
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM sizes
), two AS (
  SELECT file, begin, strlen(body)::BIGINT AS size, sha256(body) AS a, sha256('WARC/1.0' || body[9:]) AS bad, coalesce(page_id % 50, 0) AS rest
  FROM records JOIN places USING (file, record)
), sides AS (
  SELECT file, begin, sum(size)::BIGINT AS size_a, CASE count(*) WHEN 1 THEN min(a) ELSE sha256(string_agg(a, ',' ORDER BY a)) END AS hash_a,
    sum(size) FILTER (rest <> 31)::BIGINT AS size_b,
    CASE count(*) FILTER (rest <> 31) WHEN 0 THEN NULL WHEN 1 THEN min(CASE rest WHEN 7 THEN bad ELSE a END) FILTER (rest <> 31)
      ELSE sha256(string_agg(CASE rest WHEN 7 THEN bad ELSE a END, ',' ORDER BY CASE rest WHEN 7 THEN bad ELSE a END) FILTER (rest <> 31)) END AS hash_b
  FROM two GROUP BY file, begin
)
SELECT file, begin, size_a, size_b, hash_a, hash_b, CASE WHEN hash_b IS NULL THEN 'missing_b' ELSE 'changed' END AS kind
FROM sides WHERE hash_b IS DISTINCT FROM hash_a"""

# --- license scans -------------------------------------------------------------------

_TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
ORACLES["op4_license_scans"] = f"""
WITH numbered AS (SELECT row_number() OVER () AS d, doc_id, coalesce(doc_id, -1) AS n, coalesce(source, 'none') AS source, coalesce(text, '') AS text FROM documents),
files AS (
  SELECT d, doc_id, text, CASE WHEN n % 10 <> 0 OR (n // 10) % 3 = 2 THEN source || '/' || ((n // 100) % 10) || '/' || ((n // 1000) % 10)
    WHEN (n // 10) % 3 = 1 THEN source || '/' || ((n // 100) % 10) ELSE source END AS dir,
    CASE WHEN n % 10 = 0 THEN 'LICENSE-' ELSE 'file-' END || n AS name FROM numbered
), templates AS (
  SELECT t, license, word, count(*) AS tf FROM (SELECT t, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word
    FROM (VALUES {_TEMPLATES}) v(t, license, text)) GROUP BY ALL
), units AS (
  SELECT d, 0 AS unit, text AS line FROM files UNION ALL
  SELECT d, i AS unit, lines[i] AS line FROM (SELECT d, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT d, string_split(text, chr(10)) AS lines FROM files))
), words AS (SELECT d, unit, word, count(*) AS tf FROM (SELECT d, unit, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM units) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM words WHERE unit = 0 GROUP BY word),
total AS (SELECT count(*) AS n FROM files),
idf AS (SELECT word, ln((1 + n) / (1 + coalesce(df, 0))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT word FROM templates) LEFT JOIN df USING (word), total),
lengths AS (
  SELECT d, unit, sqrt(sum(coalesce(tf * idf * tf * idf, tf * (ln(1 + n) + 1) * (ln(1 + n) + 1)))) AS length
  FROM words LEFT JOIN idf USING (word), total GROUP BY d, unit
), sizes AS (SELECT t, sqrt(sum(tf * idf * tf * idf)) AS size, count(*) FILTER (regexp_full_match(word, '[0-9]+')) AS numbers FROM templates JOIN idf USING (word) GROUP BY t),
scored AS (
  SELECT d, unit, license, round(product / length, 6) AS similarity FROM (
    SELECT w.d, w.unit, t.t, t.license, sum(w.tf * idf * t.tf * idf / size) AS product
    FROM words w JOIN templates t USING (word) JOIN idf USING (word) JOIN sizes s ON s.t = t.t GROUP BY w.d, w.unit, t.t, t.license, s.numbers
    HAVING count(*) FILTER (regexp_full_match(word, '[0-9]+')) = s.numbers
  ) JOIN lengths USING (d, unit)
), best AS (
  SELECT d, license, similarity, CASE unit WHEN 0 THEN 'file' ELSE 'header' END AS how FROM scored WHERE similarity >= 0.6
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY similarity DESC, unit, license) = 1
), own AS (SELECT d, doc_id, dir, dir || '/' || name AS path, name, license, similarity, how FROM files LEFT JOIN best USING (d)),
given AS (
  SELECT dir AS ancestor, license AS i_license, path AS i_path FROM own WHERE license IS NOT NULL AND name LIKE 'LICENSE%'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path, license) = 1
), above AS (
  SELECT d, i_license, i_path FROM own JOIN given ON dir = ancestor OR starts_with(dir, ancestor || '/')
  QUALIFY row_number() OVER (PARTITION BY d ORDER BY length(ancestor) DESC) = 1
)
SELECT doc_id, path, coalesce(license, i_license) AS license, similarity,
  CASE WHEN license IS NOT NULL THEN how WHEN i_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN license IS NULL THEN i_path END AS inherited_from
FROM own LEFT JOIN above USING (d)"""

# --- secret scans --------------------------------------------------------------------

_BEFORE = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?"""
_SECRETS = (
    ("assign", _BEFORE + "[A-Za-z0-9+/_.=-]+"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]*"), 
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----|\\r?\\n[A-Za-z0-9+/=\\r\\n]{16,}|)"),
    ("forge", "gh[oprsu]_[A-Za-z0-9]{36,}"),
)
_SEARCH = " UNION ALL ".join(
    f"SELECT d, {k} AS ord, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS pieces FROM d"
    for k, (kind, pattern) in enumerate(_SECRETS)
)
ORACLES["op5_secret_scans"] = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS text FROM documents),
searched AS ({_SEARCH}),
placed AS (
  SELECT d, ord, kind, found[k] AS hit,
    list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS b
  FROM (SELECT *, unnest(generate_series(1, len(found))) AS k FROM searched WHERE len(found) > 0)
), spans AS (
  SELECT d, ord, kind, b, kind || ':' || b::BIGINT || ':' || (b + length(hit))::BIGINT AS span FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(hit, '^{_BEFORE}', '')) >= 6
    WHEN 'access' THEN length(hit) >= 20 WHEN 'hex' THEN length(hit) >= 24 ELSE true END
), per_doc AS (
  SELECT d, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(span, ',' ORDER BY b, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY b, ord) AS spans
  FROM spans GROUP BY d
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (d)"""

# --- substring dedup ----------------------------------------------------------------

ORACLES["op6_substring_dedup"] = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), w AS (SELECT row_number() OVER () AS d, * FROM split),
starts AS (
  SELECT d, i, hash(array_to_string(words[i:i + 34], ' ')) AS h, array_to_string(words[i:i + 34], ' ') AS run
  FROM (SELECT d, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35)
), twice AS (SELECT h, run FROM starts GROUP BY h, run HAVING count(*) > 1),
hit AS (SELECT s.d, s.i FROM starts s JOIN twice t ON s.h = t.h AND s.run = t.run),
gone AS (SELECT DISTINCT d, unnest(generate_series(i, i + 34)) AS i FROM hit),
lost AS (SELECT d, list(i ORDER BY i) AS places, count(*) AS n FROM gone GROUP BY d)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE
    list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (d)"""

# --- benchmark decontamination --------------------------------------------------------

# lower() would change other letters as well.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES["op10_decontamination"] = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS words FROM benchmark),
sized AS (SELECT item, words, least(13, len(words)) AS n FROM items WHERE len(words) > 0),
runs AS (
  SELECT n, array_to_string(words[i:i + n - 1], ' ') AS run, list(DISTINCT item) AS names
  FROM (SELECT item, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM sized) GROUP BY ALL
), docs AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS words FROM documents),
starts AS (
  SELECT d, n, i, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM (SELECT d, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i
        FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(words) >= n)
), hit AS (SELECT d, n, i, names FROM starts JOIN runs USING (n, run)),
words_hit AS (SELECT d, count(DISTINCT i) AS n_hit FROM (SELECT d, unnest(generate_series(i, i + n - 1)) AS i FROM hit) GROUP BY d),
found AS (SELECT d, list(DISTINCT item ORDER BY item) AS names FROM (SELECT d, unnest(names) AS item FROM hit) GROUP BY d)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(names), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN words_hit USING (d) LEFT JOIN found USING (d)"""

# --- exact dedup ----------------------------------------------------------------------

ORACLES["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

# --- ranked lexical search --------------------------------------------------------------

_TERMS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLES["op12_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (SELECT DISTINCT q, unnest(terms) AS term FROM q),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_all FROM d WHERE len(terms) > 0),
tf AS (
  SELECT d, n, term, count(*)::BIGINT AS tf FROM (SELECT d, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), corpus
), impact AS (
  SELECT d, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_all)))) AS impact
  FROM tf JOIN weight USING (term), corpus
), scored AS (SELECT q, d, sum(impact)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY q, d),
best AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
  FROM scored JOIN d USING (d) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best JOIN q USING (q) WHERE rank <= 10"""

# --- importance resampling --------------------------------------------------------------

# CRC-32 byte by byte: each byte's table entry follows from eight shifts.
_ENTRY = "list_reduce([b::UBIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(word)), "
    "lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::BIGINT, 2))::UBIGINT)), "
    "lambda c, b: xor(c >> 8, entries[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"
)

ORACLES["op13_importance_resampling"] = f"""
WITH table_of AS (SELECT list({_ENTRY} ORDER BY b) AS entries FROM (SELECT unnest(generate_series(0, 255)) AS b)),
d AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS words FROM documents),
dw AS (SELECT d, word, count(*)::BIGINT AS n FROM (SELECT d, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY word),
place AS (
  SELECT word, ({_CRC} % 10000)::INTEGER AS bucket
  FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)), table_of
), s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN place USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN place USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::BIGINT AS s_all, coalesce((SELECT sum(t) FROM t), 0)::BIGINT AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weighed AS (
  SELECT d, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN place USING (word) JOIN gain USING (bucket) GROUP BY d
), scored AS (
  SELECT d, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (d)
), placed AS (
  SELECT d, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM placed) THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN placed USING (d)"""
