"""SQL of the operators that SQL can express, for whole tables."""

LINES = r"""
WITH lines AS (
  SELECT doc_id, i, l.line AS line FROM (
    SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)),
             lambda x, k: {'line': x, 'k': k})) AS l, generate_subscripts(
             string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS gone
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT doc_id, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM filled WHERE gone),
run_sizes AS (SELECT doc_id, g, count(*) AS size FROM runs GROUP BY ALL),
per_doc AS (SELECT doc_id, count(*) AS n_runs, max(size) AS longest_run FROM run_sizes GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM filled GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.i = f.i
  WHERE NOT coalesce(f.gone, false) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run,
       md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN per_doc USING (doc_id)
LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
windows AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 19), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM docs WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM later, range(20) t(o)),
marked AS (
  SELECT words.doc_id, words.p, word, gone.p IS NOT NULL AS gone
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

#: Ends in the table ``rated`` of all documents with their targets and copies.
MIX_RATED = r"""
sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
classed AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)::BIGINT) AS class,
         coalesce(doc_id, 0) % 64 AS shard
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM classed GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         3.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nr, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (
             ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM weighed),
held AS (
  SELECT nr AS first_free, rest / heavy AS level FROM levels WHERE rest * weight < cap * heavy
  ORDER BY nr LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN nr >= first_free THEN level * weight ELSE cap END AS target
  FROM levels LEFT JOIN held ON true),
placed AS (
  SELECT c.*, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || md5('42/' || coalesce(c.source, ''))[1:8])::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY c.source ORDER BY class, shard, doc_id) AS place
  FROM classed c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source),
rated AS (
  SELECT *, least(floor(place * rate + u) - floor((place - 1) * rate + u), 3)::BIGINT AS n_copies FROM placed)
"""

MIXING = ("WITH" + MIX_RATED.format(docs="documents")
          + "SELECT doc_id, size, source_size, target, n_copies * size AS taken FROM rated")

#: A window of k words that occurs twice stands for every repeat of k words or more: their union is that of
#: the maximal repeats, and a repeat longer than 200 words is a window of 201 that occurs twice.
REPEATS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM docs),
lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per_line AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
windows AS (
  SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS part
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM docs, (VALUES (3), (8), (201)) t(k) WHERE len(w) >= k)),
twice AS (
  SELECT r, k, p FROM (SELECT r, k, p, count(*) OVER (PARTITION BY r, k, md5(part)) AS n FROM windows) WHERE n > 1),
words AS (SELECT DISTINCT r, k, p + o AS p FROM twice, range(8) t(o) WHERE k < 201 AND o < k),
marked AS (
  SELECT r, count(*) FILTER (k = 3) AS n_repeat_words, count(*) FILTER (k = 8) AS n_covered_words
  FROM words GROUP BY r),
long_ones AS (SELECT DISTINCT r FROM twice WHERE k = 201),
counted AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered_words, 0) AS n_covered_words,
         long_ones.r IS NOT NULL AS too_long
  FROM base LEFT JOIN per_line USING (r) LEFT JOIN marked USING (r) LEFT JOIN long_ones ON base.r = long_ones.r),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_covered_words <= 40 * n_words AND NOT too_long AS kept, n_covered_words
FROM judged
"""

MIDDLES = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
         array_to_string(u[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
