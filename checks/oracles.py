"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from checks.tables import CONTENT_TYPES
from waypost.functions.scoring import INTENT_BONUS, INTENT_CONFLICTS, INTENT_LABELS

ORACLES: dict[str, str] = {}

# The named entities that the tables hold; the ampersand goes last.
ENTITIES = {
    "&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\xa0",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—",
    "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&amp;": "&",
}

SITE = "CASE WHEN url LIKE 'https:%' THEN 'target' ELSE 'source' END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def raw_path(url: str) -> str:
    found = (f"regexp_extract({url}, "
             r"'^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)")
    return f"regexp_replace({found}, ';[^/]*$', '')"


def path(url: str) -> str:
    return f"coalesce(nullif(rtrim({raw_path(f'lower(trim({url}))')}, '/'), ''), '/')"


def host(url: str) -> str:
    return f"regexp_extract({url}, '^[a-zA-Z]+://([^/?#]*)', 1)"


def origin(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([a-zA-Z]+://[^/?#]*)', 1))"


def segments(url: str) -> str:
    return f"list_filter(string_split(lower({raw_path(url)}), '/'), lambda s: s <> '')"


def decoded(text: str) -> str:
    for entity, char in ENTITIES.items():
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    return text


BLANKS = quoted(" \t\r\n\xa0")


def stripped(text: str) -> str:
    return f"trim({text}, {BLANKS})"


def label_at(number: str) -> str:
    labels = ", ".join(quoted(label) for label in (*INTENT_LABELS, ""))
    return f"([{labels}])[({number}) % 6 + 1]"


TITLE = stripped(decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))
H1_PARTS = r"regexp_extract_all(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1', 1)"
H1 = (f"array_to_string(list_transform({H1_PARTS}, lambda h: array_to_string(list_transform("
      f"regexp_split_to_array(h, '<[^>]*>'), lambda p: {stripped(decoded('p'))}), '')), ' | ')")
BODY_HTML = (r"regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1), "
             r"'(?is)</body\s*>.*', '')")
MARKUP = (r"'(?is)<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>"
          r"|<template[^>]*>.*?</template\s*>|<[^>]*>|<[a-z/!][^>]*$'")


def body(decode) -> str:
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({BODY_HTML}, "
            f"{MARKUP}), lambda p: {stripped(decode('p'))}), lambda p: p <> ''), ' ')")


def also_bare_ampersand(text: str) -> str:
    """Standard parsing also decodes an ampersand cut off before its semicolon."""
    return decoded(f"regexp_replace({text}, '&amp$', '&amp;')")


# Pages of the two sites with their text and derived URL columns.
PAGES = f"""
raw_pages AS (
  SELECT page_id, url, {SITE} AS site, {TITLE} AS title, {H1} AS h1,
         {label_at('length(url)')} AS intention
  FROM pages),
idx AS (
  SELECT *, regexp_extract(lower(url), '^([a-z]+:)', 1) || '//' || {host('lower(url)')}
            || {path('url')} AS normalized_url,
         {path('url')} AS path, {segments('url')} AS segments
  FROM raw_pages),
txt AS (
  SELECT *, title || ' ' || h1 || '  ' || translate(normalized_url, '/-_', '   ') AS match_text
  FROM idx)"""

PATHS = """
tpaths AS (
  SELECT path, arg_max(url, page_id) AS target_url, max(page_id) AS target_page_id,
         arg_max(intention, page_id) AS target_intention, min(page_id) AS first_id
  FROM tgt GROUP BY path)"""

SITES = "src AS (SELECT * FROM txt WHERE site = 'source'), tgt AS (SELECT * FROM txt WHERE site = 'target')"

# TF-IDF fitted on the target pages.
TERMS = r"""
tokens AS (
  SELECT page_id, site, regexp_extract_all(lower(match_text), '[\p{L}\p{N}_]{2,}') AS tok FROM txt),
occ AS (
  SELECT page_id, site, unnest(tok || list_transform(range(1, len(tok)),
         lambda i: tok[i] || ' ' || tok[i + 1])) AS term FROM tokens),
tf AS (SELECT page_id, site, term, count(*) AS tf FROM occ GROUP BY ALL),
n AS (SELECT count(*) AS n FROM tgt),
vocab AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total,
         ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf, n WHERE site = 'target' GROUP BY term HAVING count(*) <= 0.9 * any_value(n)),
w AS (SELECT page_id, site, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (
  SELECT page_id, site, term, w / sqrt(sum(w * w) OVER (PARTITION BY page_id)) AS weight FROM w)"""

COSINE = """
dots AS (
  SELECT s.page_id, t.page_id AS target_page_id, round(sum(s.weight * t.weight), 9) AS score
  FROM weights s JOIN weights t USING (term)
  WHERE s.site = 'source' AND t.site = 'target' GROUP BY ALL),
cosine AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, target_page_id) AS rn
    FROM dots) WHERE rn = 1 AND score >= 0.30)"""

# Longest common subsequence by dynamic programming: one list per row of the table.
FUZZY = """
pairs AS (
  SELECT s.path, t.path AS tpath, t.first_id, t.target_url
  FROM (SELECT DISTINCT path FROM src) s, tpaths t),
lcs AS (
  SELECT *, list_reduce(
    list_prepend(list_transform(range(0, length(tpath) + 1), lambda z: CAST(0 AS BIGINT)),
      list_transform(range(1, length(path) + 1),
        lambda i: list_transform(range(0, length(tpath) + 1),
          lambda j: CAST(CASE WHEN j > 0 AND path[i] = tpath[j] THEN 1 ELSE 0 END AS BIGINT)))),
    lambda prev, hit: list_transform(range(0, length(tpath) + 1),
      lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(list_transform(range(1, j + 1),
        lambda k: greatest(prev[k + 1], prev[k] + hit[k + 1]))) END)
  )[-1] AS common FROM pairs),
fuzzy AS (
  SELECT * FROM (
    SELECT path, first_id, target_url, score,
           row_number() OVER (PARTITION BY path ORDER BY score DESC, first_id) AS rn
    FROM (SELECT *, 100.0 - 100.0 * (length(path) + length(tpath) - 2 * common)
                    / (length(path) + length(tpath)) AS score FROM lcs)
    WHERE score >= 80) WHERE rn = 1)"""

#: Clusters of equal vectors are the segments, numbered by size and then by first page.
SEGMENTS = f"""WITH ranked AS (
  SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)) - 1 AS place
  FROM customer GROUP BY c_mktsegment),
labelled AS (
  SELECT CAST(c_custkey AS BIGINT) AS page_id, CAST(place AS INTEGER) AS cluster_label,
         {label_at('place % 5')} AS intention FROM customer JOIN ranked USING (c_mktsegment))"""

ANCESTORS = """
ups AS (
  SELECT page_id, lvl AS level,
         '/' || array_to_string(segments[1:len(segments) - lvl], '/') AS path
  FROM (SELECT page_id, segments, unnest(range(1, least(3, len(segments) - 1) + 1)) AS lvl
        FROM climbers)),
near AS (
  SELECT page_id, min(level) AS level, arg_min(target_url, level) AS target_url,
         arg_min(target_page_id, level) AS target_page_id,
         arg_min(target_intention, level) AS target_intention
  FROM ups JOIN tpaths USING (path) GROUP BY page_id)"""


def climbed(fallback: str, with_root: bool = True) -> str:
    """Ancestor, root or fallback for every row of ``climbers``; needs ANCESTORS."""
    root = "path = '/'" if with_root else "false"
    return f"""
root AS (SELECT * FROM tpaths WHERE {root}),
climbed AS (
  SELECT c.page_id, c.url, c.intention,
    coalesce(n.target_url, r.target_url, {quoted(fallback)}) AS target_url,
    CASE WHEN n.level IS NOT NULL THEN n.target_page_id ELSE r.target_page_id END AS target_page_id,
    CASE WHEN n.level IS NOT NULL THEN n.target_intention
         WHEN r.path IS NOT NULL THEN r.target_intention
         ELSE (SELECT max(intention) FROM tgt WHERE url = {quoted(fallback)}) END AS target_intention,
    CASE WHEN n.level IS NOT NULL THEN 'hierarchical_L' || n.level
         WHEN r.path IS NOT NULL THEN 'hierarchical_root' ELSE 'fallback' END AS match_type,
    CASE n.level WHEN 1 THEN 40.0 WHEN 2 THEN 25.0 WHEN 3 THEN 15.0
         ELSE CASE WHEN r.path IS NOT NULL THEN 5.0 ELSE 0.0 END END AS score
  FROM climbers c LEFT JOIN near n USING (page_id) LEFT JOIN root r ON true)"""


def tier(kind: str = "match_type", score: str = "score") -> str:
    return f"""CASE WHEN {kind} = 'exact' THEN 'high'
      WHEN {kind} = 'cosine' THEN CASE WHEN {score} >= 0.7 THEN 'high' WHEN {score} >= 0.4
           THEN 'medium' ELSE 'low' END
      WHEN {kind} = 'fuzzy' THEN CASE WHEN {score} >= 85 THEN 'high' WHEN {score} >= 70
           THEN 'medium' ELSE 'low' END
      WHEN {kind} = 'hierarchical_L1' THEN 'medium' ELSE 'low' END"""


CONFLICT = "(source_intention, target_intention) IN (" + ", ".join(
    f"({quoted(a)}, {quoted(b)})" for a, b in INTENT_CONFLICTS) + ")"
ADJUSTED = f"""CASE WHEN {CONFLICT} THEN 'low'
      WHEN source_intention = target_intention AND source_intention IN
           ({", ".join(quoted(x) for x in INTENT_BONUS)})
      THEN CASE raw_confidence WHEN 'low' THEN 'medium' ELSE 'high' END
      ELSE raw_confidence END"""

REDIRECTS = f"""
tiered AS (
  SELECT page_id AS source_page_id, url AS source_url, target_url, match_type,
         CASE WHEN match_type = 'cosine' THEN round(score, 4) ELSE round(score, 2) END AS score,
         {tier()} AS raw_confidence, intention AS source_intention,
         coalesce(target_intention, '') AS target_intention
  FROM merged),
redirects AS (
  SELECT source_page_id, source_url, target_url, match_type, score, raw_confidence,
         {ADJUSTED} AS confidence, source_intention, target_intention,
         {CONFLICT} AS intent_mismatch
  FROM tiered)"""

SHOP_SOURCE = "replace(lower(p_brand), '#', '-')"
SHOP = f"""
shop AS (
  SELECT *, '/Shop/' || p_type || '/' || {SHOP_SOURCE} AS folder, '/Shop/' || p_type AS shelf,
         replace(lower(p_name), ' ', '-') || '-' || p_partkey AS slug
  FROM part),
src0 AS (
  SELECT p_partkey * 2 AS page_id, CASE WHEN p_size > 45 THEN 'https://old.example/Archive'
         ELSE 'https://old.example' END || folder || '/' || slug || '?ref=list' AS url,
         {label_at('p_size')} AS intention FROM shop),
kept AS (
  SELECT lower(folder || '/' || slug) AS path, p_partkey, p_size, 1 AS shift FROM shop WHERE p_size <= 10
  UNION ALL SELECT lower(folder), p_partkey, p_size, 100000001 FROM shop WHERE p_brand < 'Brand#2'
  UNION ALL SELECT lower(shelf), p_partkey, p_size, 200000001 FROM shop WHERE p_type < 'M'
  UNION ALL SELECT '', p_partkey, p_size, 300000001 FROM shop WHERE p_type < 'M'
  UNION ALL SELECT '/archive/shop', p_partkey, p_size, 400000001 FROM shop WHERE p_size > 45),
tgt0 AS (
  SELECT min(p_partkey) * 2 + shift AS page_id, 'https://new.example' || path || '/' AS url,
         {label_at('min(p_size)')} AS intention FROM kept GROUP BY path, shift),
src AS (SELECT *, {path('url')} AS path, {segments('url')} AS segments FROM src0),
tgt AS (SELECT *, {path('url')} AS path FROM tgt0),
{PATHS}"""

HOME = "https://new.example/home"
SHOP_PLAN = f"""WITH {SHOP},
climbers AS (SELECT * FROM src WHERE path NOT IN (SELECT path FROM tpaths)), {ANCESTORS},
{climbed(HOME)},
merged AS (
  SELECT page_id, url, intention, target_url, target_intention, 'exact' AS match_type, 100.0 AS score
  FROM src JOIN tpaths USING (path)
  UNION ALL
  SELECT page_id, url, intention, target_url, target_intention, match_type, score FROM climbed),
{REDIRECTS}"""

RULES = f"""{SHOP_PLAN},
rules AS (
  SELECT *, coalesce(nullif({raw_path("replace(source_url, 'https://old.example', '')")}, ''), '/')
            AS source_path,
         CASE WHEN starts_with(target_url, '/') THEN 'https://new.example' || target_url
              ELSE target_url END AS target
  FROM redirects)"""
SECTION = ("CASE WHEN match_type = 'fallback' THEN 'fallback' WHEN confidence IN ('high', 'medium') "
           "THEN confidence ELSE 'low' END")
ESCAPED = r"regexp_replace(ltrim(source_path, '/'), '([.?+*^${}()|\[\]\\])', '\\\1', 'g')"


def apache(target: str) -> str:
    return f"'RewriteRule ^' || {ESCAPED} || '$ ' || {target} || ' [R=301,L]'"


def nginx(target: str) -> str:
    return f"""'    "' || replace(source_path, ' ', '%20') || '" "' || {target} || '";'"""


OWN = "regexp_matches(target, '^https://new\\.example([/?#]|$)')"
AFTER = "substr(target, 20)"

DOCS = """
docs AS (
  SELECT doc_id AS page_id, 'https://docs.example/' || lang || '/' || md5(text) AS url, lang AS site,
         source AS title, text AS body_text, md5(text) AS content_hash FROM documents)"""

ROBOTS = f"""
robots AS (
  SELECT {origin('lower(url)')} AS origin,
    'User-agent: crawler' || chr(10) || 'Disallow: '
    || regexp_extract(max(lower(url)), '//[^/]*(/[^/?#]*)', 1) || chr(10) || chr(10)
    || 'User-Agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /' || chr(10)
    || '  disallow: ' || regexp_extract(min(lower(url)), '//[^/]*(/[^?#]*)', 1)
    || CASE WHEN count(*) > 1 THEN chr(10) || 'Allow: /' || chr(10) || 'Sitemap: '
       || {origin('lower(url)')} || '/map-' || count(*) || '.xml ' ELSE '' END
    || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /en' AS robots_txt
  FROM pages GROUP BY {origin('lower(url)')}),
lines AS (
  SELECT origin, trim(line) AS line, pos
  FROM (SELECT origin, unnest(string_split(robots_txt, chr(10))) AS line,
               generate_subscripts(string_split(robots_txt, chr(10)), 1) AS pos FROM robots)),
agents AS (
  SELECT *, last_value(CASE WHEN lower(line) LIKE 'user-agent:%' THEN trim(substr(line, 12)) END
                       IGNORE NULLS) OVER (PARTITION BY origin ORDER BY pos) AS agent FROM lines),
rules AS (
  SELECT origin, trim(substr(line, 10)) AS rule FROM agents
  WHERE agent = '*' AND lower(line) LIKE 'disallow:%' AND trim(substr(line, 10)) NOT IN ('', '/'))"""

LINKS = f"""
hrefs AS (
  SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
edges AS (
  SELECT url AS src_url, {origin('url')} || {raw_path(decoded('href'))} AS dst_url FROM hrefs)"""

GRAPH = """
seeds AS (SELECT 'supplier/' || s_suppkey AS url FROM supplier WHERE s_nationkey = 7),
edges AS (
  SELECT 'part/' || l_partkey AS a, 'supplier/' || l_suppkey AS b FROM lineitem
  UNION SELECT 'supplier/' || l_suppkey, 'part/' || l_partkey FROM lineitem)"""


def walk(depth: int) -> str:
    return f"""
walk AS (
  SELECT url, 0 AS depth FROM seeds
  UNION SELECT b, depth + 1 FROM walk JOIN edges ON a = url WHERE depth < {depth}),
reached AS (SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url)"""


GRADED = f"""
graded AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    (['exact', 'cosine', 'fuzzy', 'hierarchical_L1', 'hierarchical_L2', 'hierarchical_root',
      'fallback'])[l_linenumber % 7 + 1] AS match_type,
    CASE WHEN l_linenumber % 7 = 1 THEN l_quantity / 50 ELSE l_quantity * 2 END AS score,
    {label_at('l_suppkey')} AS source_intention, {label_at('l_partkey')} AS target_intention
  FROM lineitem)"""

IDX = f"WITH {PAGES}"

ORACLES.update({
    "url_normalize": f"{IDX} SELECT page_id, normalized_url, path, md5(path) AS url_hash FROM idx",
    "url_segments": f"{IDX} SELECT page_id, CAST(to_json(segments) AS VARCHAR) AS segments_json, "
                    "len(segments) AS n_segments FROM idx",
    "url_parents": f"""{IDX} SELECT page_id,
        CASE WHEN len(segments) > 1 THEN '/' || array_to_string(segments[1:-2], '/') END AS parent_path,
        CASE WHEN len(segments) > 0 THEN '/' || segments[1] END AS level_one_path FROM idx""",
    "url_ancestors": f"WITH {SHOP}, climbers AS (SELECT * FROM src), {ANCESTORS} "
                     "SELECT page_id, level, path FROM ups",
    "match_text": f"{IDX} SELECT page_id, match_text FROM txt",
    "site_scan": "SELECT page_id, url FROM pages WHERE url LIKE 'https:%'",
    "pages_per_site": f"SELECT {SITE} AS site, count(*) AS pages FROM pages GROUP BY 1",
    "dedupe_pages": f"WITH {DOCS} SELECT min(page_id) AS page_id, url, site FROM docs GROUP BY url, site",
    "insert_or_ignore": f"""WITH {DOCS}
        SELECT min(page_id) AS page_id, url FROM docs WHERE url NOT IN (
          SELECT url FROM docs WHERE page_id IN (SELECT doc_id FROM labels)) GROUP BY url""",
    "resume_antijoin": "SELECT page_id, url FROM pages WHERE NOT url LIKE 'https:%'",
    "first_per_site": f"""WITH {DOCS} SELECT page_id, site FROM docs
        QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) <= 100""",
    "distinct_in_order": f"WITH {DOCS} SELECT url, min(page_id) AS ord FROM docs GROUP BY url",
    "content_duplicates": f"""WITH {DOCS} SELECT site, content_hash, count(*) AS pages,
        min(page_id) AS first_page_id FROM docs GROUP BY site, content_hash HAVING count(*) > 1""",
    "extract_head": f"SELECT page_id, {TITLE} AS title, '' AS description, {H1} AS h1 FROM pages",
    "extract_body": f"""WITH b AS (SELECT page_id, {body(decoded)} AS body_text FROM pages)
        SELECT page_id, body_text, md5(body_text) AS content_hash FROM b""",
    "extract_parser": f"""WITH b AS (SELECT page_id, {TITLE} AS title, '' AS description, {H1} AS h1,
        {body(also_bare_ampersand)} AS body_text FROM pages)
        SELECT *, md5(body_text) AS content_hash FROM b""",
    "extract_stubs": f"""WITH b AS (
          SELECT page_id, url, html LIKE '%</html>%' AS ok, {TITLE} AS title, {H1} AS h1,
                 {body(decoded)} AS body_text FROM pages)
        SELECT page_id, CASE WHEN ok THEN 200 ELSE 0 END :: BIGINT AS status_code,
          CASE WHEN ok THEN title ELSE replace(regexp_extract(rtrim({raw_path('url')}, '/'),
               '([^/]*)$', 1), '-', ' ') END AS title,
          CASE WHEN ok THEN h1 ELSE '' END AS h1,
          md5(CASE WHEN ok THEN body_text ELSE '' END) AS content_hash FROM b""",
    "admissible_pages": f"""SELECT page_id, url FROM pages WHERE CASE WHEN url LIKE '%.html%' THEN
        {quoted(CONTENT_TYPES[1])} ELSE {quoted(CONTENT_TYPES[0])} END LIKE '%text/html%'
        AND length(html) >= 2000""",
    "extract_links_of_pages": f"WITH {LINKS} SELECT src_url, dst_url FROM edges",
    "products": """SELECT p_partkey AS page_id,
        CASE WHEN p_size > 25 AND p_size <= 40 THEN '77' || p_partkey
             ELSE '99' || p_partkey END AS ean,
        CASE WHEN p_size > 25 AND p_size <= 40 THEN '77' || p_partkey
             ELSE '99' || p_partkey END AS gtin,
        CAST(p_partkey AS VARCHAR) AS sku, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
        'EUR' AS currency, p_brand AS brand, p_name AS product_name, p_type AS product_type,
        p_brand || '=/b/' || p_brand || '>' || p_name || '=/p/' || p_partkey AS breadcrumb FROM part""",
    "robots_rules": f"WITH {ROBOTS} SELECT origin, rule FROM rules",
    "intent_segments": f"""{SEGMENTS} SELECT page_id, cluster_label, intention FROM labelled""",
    "intent_segments_summary": f"""{SEGMENTS} SELECT intention, count(*) AS pages FROM labelled GROUP BY intention""",
    "robots_filter": f"""WITH {ROBOTS} SELECT page_id, url FROM pages p WHERE NOT EXISTS (
        SELECT 1 FROM rules r WHERE r.origin = {origin('p.url')}
        AND starts_with({raw_path('p.url')}, r.rule))""",
    "discover_sitemaps": f"""WITH {ROBOTS}, found AS (
          SELECT origin, trim(substr(line, 9)) AS sitemap_url FROM lines WHERE line ILIKE 'sitemap:%')
        SELECT * FROM found UNION ALL
        SELECT origin, origin || '/sitemap.xml' FROM robots WHERE origin NOT IN (SELECT origin FROM found)""",
    "sitemap_urls": "SELECT DISTINCT url FROM pages",
    "merge_seeds": f"""WITH {DOCS} SELECT url, min(ord) AS ord FROM (
          SELECT url, page_id AS ord FROM docs WHERE page_id IN (SELECT doc_id FROM labels)
          UNION ALL SELECT url, 9223372036854775807 FROM docs) GROUP BY url""",
    "link_bfs": f"WITH RECURSIVE {GRAPH}, {walk(3)} SELECT url, depth FROM reached",
    "link_bfs_capped": f"""WITH RECURSIVE {GRAPH}, {walk(5)}
        SELECT url, depth FROM reached ORDER BY depth, url LIMIT 150""",
    "discover_urls": f"""WITH RECURSIVE {ROBOTS}, {LINKS},
        allowed AS (
          SELECT u FROM (SELECT url AS u FROM pages UNION SELECT dst_url FROM edges) WHERE NOT EXISTS (
            SELECT 1 FROM rules r WHERE r.origin = {origin('u')} AND starts_with({raw_path('u')}, r.rule))),
        walk AS (
          SELECT url, 0 AS depth FROM pages WHERE url IN (SELECT u FROM allowed)
          UNION SELECT dst_url, depth + 1 FROM walk JOIN edges ON src_url = url
          WHERE depth < 2 AND dst_url IN (SELECT u FROM allowed))
        SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url""",
    "tfidf_vocabulary": f"""{IDX}, {SITES}, {TERMS}
        SELECT term, df, total, round(idf, 6) AS idf FROM vocab""",
    "tfidf_weights": f"""{IDX}, {SITES}, {TERMS}
        SELECT page_id, term, round(weight, 6) AS weight FROM weights""",
    "class_weights": rf"""WITH {DOCS},
        occ AS (SELECT page_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, title, title,
                '', '', '', '', {stripped('body_text')})), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
                FROM docs WHERE body_text <> ''),
        n AS (SELECT count(*) AS n FROM docs WHERE body_text <> ''),
        tf AS (SELECT page_id, term, count(*) AS tf FROM occ GROUP BY ALL),
        vocab AS (
          SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM tf, n GROUP BY term
          HAVING count(*) >= 2 AND count(*) <= 0.85 * any_value(n)),
        w AS (SELECT page_id, term, tf * idf AS w FROM tf JOIN vocab USING (term))
        SELECT page_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY page_id)), 6) AS weight FROM w""",
    "match_exact": f"""{IDX}, {SITES}, {PATHS}
        SELECT page_id, url AS source_url, target_page_id, target_url, 'exact' AS match_type,
               100.0 :: DOUBLE AS score FROM src JOIN tpaths USING (path)""",
    "match_cosine": f"""{IDX}, {SITES}, {TERMS}, {COSINE}
        SELECT page_id, target_page_id, round(score, 4) AS score FROM cosine""",
    "match_fuzzy_paths": f"""{IDX}, {SITES}, {PATHS}, {FUZZY}
        SELECT path, target_url, round(score, 2) AS score FROM fuzzy""",
    "match_hierarchical": f"""WITH {SHOP}, climbers AS (SELECT * FROM src), {ANCESTORS}, {climbed('/')}
        SELECT page_id, url AS source_url, target_page_id, target_url, match_type,
               CAST(score AS DOUBLE) AS score FROM climbed""",
    "match_fallback": f"""WITH {SHOP}, climbers AS (SELECT * FROM src), {ANCESTORS},
        {climbed(HOME, with_root=False)}
        SELECT page_id, url AS source_url, target_page_id, target_url, match_type,
               CAST(score AS DOUBLE) AS score FROM climbed""",
    "waterfall_structural": f"{SHOP_PLAN} SELECT * REPLACE (CAST(score AS DOUBLE) AS score) FROM redirects",
    "match_full": f"""{IDX}, {SITES}, {PATHS},
        rest1 AS (SELECT * FROM src WHERE path NOT IN (SELECT path FROM tpaths)),
        {TERMS}, {COSINE}, {FUZZY},
        rest2 AS (SELECT * FROM rest1 WHERE page_id NOT IN (SELECT page_id FROM cosine)),
        climbers AS (SELECT * FROM rest2 WHERE path NOT IN (SELECT path FROM fuzzy)), {ANCESTORS},
        {climbed('/')},
        merged AS (
          SELECT page_id, url, intention, target_url, target_intention, 'exact' AS match_type,
                 100.0 :: DOUBLE AS score FROM src JOIN tpaths USING (path)
          UNION ALL
          SELECT r.page_id, r.url, r.intention, t.url, t.intention, 'cosine', c.score
          FROM rest1 r JOIN cosine c USING (page_id) JOIN tgt t ON t.page_id = c.target_page_id
          UNION ALL
          SELECT r.page_id, r.url, r.intention, f.target_url, p.target_intention, 'fuzzy', f.score
          FROM rest2 r JOIN fuzzy f USING (path) JOIN tpaths p ON p.first_id = f.first_id
          UNION ALL
          SELECT page_id, url, intention, target_url, target_intention, match_type, score FROM climbed),
        {REDIRECTS} SELECT * FROM redirects""",
    "confidence_tiers": f"WITH {GRADED} SELECT l_orderkey, l_linenumber, {tier()} AS confidence FROM graded",
    "intent_adjust": f"""WITH {GRADED}, g AS (SELECT *, {tier()} AS raw_confidence FROM graded)
        SELECT l_orderkey, l_linenumber, {ADJUSTED} AS confidence, {CONFLICT} AS intent_mismatch FROM g""",
    "upsert_classifications": f"""
        SELECT doc_id AS page_id, 0 :: BIGINT AS cluster_label, 'divers' AS intention FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT doc_id, CAST(quality AS BIGINT), {label_at('quality')} FROM labels""",
    "plan_stats": f"""{SHOP_PLAN} SELECT match_type, confidence, count(*) AS cnt FROM redirects
        GROUP BY ALL""",
    "phase_counters": f"""{SHOP_PLAN},
        phases AS (SELECT unnest(['exact', 'cosine', 'fuzzy', 'hierarchical_L1', 'hierarchical_L2',
          'hierarchical_L3', 'hierarchical_root', 'fallback']) AS phase)
        SELECT phase, count(source_url) AS cnt FROM phases LEFT JOIN redirects ON phase = match_type
        GROUP BY phase
        UNION ALL SELECT 'intent_adjusted', count(*) FROM redirects
        WHERE match_type <> 'exact' AND confidence <> raw_confidence""",
    "project_stats": f"""{SHOP_PLAN}
        SELECT (SELECT count(*) FROM src) AS source_pages, (SELECT count(*) FROM tgt) AS target_pages,
          (SELECT count(*) FROM src WHERE intention <> '')
          + (SELECT count(*) FROM tgt WHERE intention <> '') AS classified,
          count(*) AS redirects, count(*) FILTER (confidence = 'high') AS high,
          count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low
        FROM redirects""",
    "redirect_filter": f"""{SHOP_PLAN} SELECT source_url, target_url FROM redirects
        WHERE confidence = 'high' AND match_type = 'exact'""",
    "plan_csv_order": f"""{SHOP_PLAN} SELECT source_url, match_type, confidence,
        CAST(score AS DOUBLE) AS score,
        CASE match_type WHEN 'exact' THEN 0 WHEN 'cosine' THEN 1 WHEN 'fuzzy' THEN 2
             WHEN 'fallback' THEN 4 ELSE 99 END :: BIGINT AS type_rank,
        CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END :: BIGINT
             AS confidence_rank FROM redirects""",
    "plan_csv": f"""{SHOP_PLAN} SELECT source_url, target_url, match_type, CAST(score AS DOUBLE) AS score,
        confidence, source_intention, target_intention FROM redirects""",
    "plan_json": f"""{SHOP_PLAN}
        SELECT '{{"source":"' || source_url || '","target":"' || target_url || '","match_type":"'
          || match_type || '","score":' || CAST(CAST(score AS DECIMAL(6,1)) AS VARCHAR)
          || ',"confidence":"' || confidence || '","source_intent":"' || source_intention
          || '","target_intent":"' || target_intention || '"}}' AS value FROM redirects""",
    "plan_json_header": f"""{SHOP_PLAN}
        SELECT '2026-01-01T00:00:00' AS generated_at, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
          match_type, confidence, count(*) AS cnt FROM redirects GROUP BY match_type, confidence""",
    "htaccess_rules": f"{RULES} SELECT {SECTION} AS section, {apache('target')} AS line FROM rules",
    "htaccess_vhost": f"""{RULES}, v AS (SELECT * REPLACE (
          CASE WHEN {OWN} THEN 'https://%{{HTTP_HOST}}' || {AFTER} ELSE target END AS target) FROM rules)
        SELECT {SECTION} AS section, {apache('target')} AS line FROM v""",
    "htaccess_deduped": f"""{RULES}, visits AS (
          SELECT source_url || '&o=' || l_orderkey || '-' || l_linenumber AS source_url, r.* EXCLUDE source_url
          FROM rules r JOIN lineitem ON l_partkey = source_page_id // 2),
        best AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY
          CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, score DESC, source_url) = 1)
        SELECT source_url, {SECTION} AS section, {apache('target')} AS line FROM best""",
    "nginx_map": f"{RULES} SELECT {nginx('target')} AS line FROM rules",
    "nginx_map_vhost": f"""{RULES}, v AS (SELECT * REPLACE (
          CASE WHEN {OWN} THEN coalesce(nullif({AFTER}, ''), '/') ELSE target END AS target) FROM rules)
        SELECT {nginx('target')} AS line FROM v""",
    "stream_intake": f"SELECT page_id, url, {TITLE} AS title, 'source' AS site FROM pages",
})
ORACLES["stream_match"] = ORACLES["match_full"]
