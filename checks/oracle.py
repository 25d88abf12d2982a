"""The same results as SQL for another engine (DuckDB dialect).

A statement is put together from named parts; a part lists what it reads by
naming other parts, and only the needed ones become CTEs.
"""

from __future__ import annotations

import re

from siteloom.functions.text import SENTENCE, TOKEN_BREAK, WHITESPACE
from siteloom.operators.extract import (ANY_TAG, ATTRIBUTE, DOC_EXTENSIONS, IMAGE_EXTENSIONS, NOISE,
                                        TITLE)
from siteloom.operators.main_content import HEADING, LINK_CLOSE, LINK_OPEN, REWRITES

PARTS: dict[str, str] = {}
RESULTS: dict[str, str] = {}
#: The references that stand in the given pages; the ampersand last.
ENTITIES = {"lt": "<", "gt": ">", "quot": "\"", "copy": "©", "middot": "·", "amp": "&"}
#: Parts that a statement reads more than once.
SHARED = {"scores", "near", "fused", "head", "final", "covers", "second", "ix_post", "text_rank", "fused_five", "covers_five", "near_cells"}
TS = "TIMESTAMP '2024-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-04-30 00:00:00'"
SPLIT_EXT = r"(?s)^(.*[^/.][^/]*)(\.[^/.]*)$"


def statements() -> dict[str, str]:
    return {key: _assemble(sql) for key, sql in RESULTS.items()}


def _assemble(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str, above: tuple[str, ...] = ()) -> None:
        for name in PARTS:
            if name not in needed and name not in above and re.search(rf"\b(FROM|JOIN) {name}\b", text):
                visit(PARTS[name], (*above, name))
                needed.append(name)

    visit(sql)
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' * (name in SHARED)}({PARTS[name]})" for name in needed)
    return f"WITH RECURSIVE {ctes}\n{sql}" if needed else sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def minutes(col: str) -> str:
    return f"({TS} + to_minutes({col}))"


def days(col: str) -> str:
    return f"({TS} + to_days({col}::INTEGER))"


# -- expressions ---------------------------------------------------------------

def path(u: str) -> str:
    return rf"regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"


def host(u: str) -> str:
    return rf"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^:/?#@]*)', 1))"


def segments(u: str) -> str:
    return f"list_filter(string_split(lower({path(u)}), '/'), lambda s: s <> '')"


def is_lang(seg: str) -> str:
    return rf"coalesce(regexp_full_match({seg}, '\p{{L}}{{2}}'), false)"


def language(u: str) -> str:
    s = f"({segments(u)})"
    return f"CASE WHEN {is_lang(s + '[1]')} THEN {s}[1] ELSE 'unknown' END"


def section(u: str) -> str:
    s = f"({segments(u)})"
    return f"coalesce(CASE WHEN {is_lang(s + '[1]')} THEN {s}[2] ELSE {s}[1] END, 'unknown')"


def blob(u: str, suffix: str | None = None) -> str:
    decoded = f"trim(url_decode({path(u)}), '/')"
    safe = rf"regexp_replace(CASE WHEN {decoded} = '' THEN 'index' ELSE {decoded} END, '[^\p{{L}}\p{{N}}\-_/.]', '-', 'g')"
    stem = f"CASE WHEN regexp_matches({safe}, {q(SPLIT_EXT)}) THEN regexp_extract({safe}, {q(SPLIT_EXT)}, 1) ELSE {safe} END"
    ending = suffix or f"regexp_extract({safe}, {q(SPLIT_EXT)}, 2)"
    return f"(({stem}) || '-' || substr(sha256({u}), 1, 10) || {ending})"


def base_name(u: str) -> str:
    return rf"regexp_replace({blob(u)}, '(?i)\.html?$', '')"


def extension(u: str) -> str:
    return f"lower(regexp_extract({path(u)}, {q(SPLIT_EXT)}, 2))"


def flat(t: str) -> str:
    return f"trim(regexp_replace({t}, {q(WHITESPACE)}, ' ', 'g'), ' ')"


def header_safe(t: str) -> str:
    return f"CASE WHEN length({flat(t)}) = strlen({flat(t)}) THEN {flat(t)} ELSE url_encode({flat(t)}) END"


def unescape(t: str) -> str:
    for name, char in ENTITIES.items():
        t = f"replace({t}, '&{name};', {q(char)})"
    return t


def tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({t}), {q(TOKEN_BREAK)}), lambda t: t <> '')"


def sentences(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, {q(SENTENCE)}), lambda s: {flat('s')}), lambda s: s <> '')"


def title(h: str) -> str:
    return f"regexp_replace({unescape(f'regexp_extract({h}, {q(TITLE)}, 1)')}, {q('^' + WHITESPACE + '|' + WHITESPACE + '$')}, '', 'g')"


def visible(h: str) -> str:
    return flat(unescape(f"regexp_replace(regexp_replace({h}, {q(NOISE)}, ' ', 'g'), {q(ANY_TAG)}, ' ', 'g')"))


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S+00:00')"


def join_ref(base: str, ref: str) -> str:
    """References of the test pages: absolute, from the root, or plain relative."""
    origin = f"regexp_extract({base}, '^[A-Za-z]+://[^/?#]*')"
    folder = f"regexp_extract({base}, '^[A-Za-z]+://[^?#]*/')"
    return rf"""CASE WHEN regexp_matches({ref}, '^[A-Za-z]+:') THEN {ref}
        WHEN starts_with({ref}, '/') THEN {origin} || {ref}
        ELSE {folder} || {ref} END"""


def attribute(markup: str, tag: str, name: str) -> str:
    pattern = ATTRIBUTE.format(tag=tag, name=name)
    return f"list_transform(regexp_extract_all({markup}, {q(pattern)}, 1), lambda v: trim(v, '\"'))"


# -- derived inputs ------------------------------------------------------------

PARTS["pg"] = f"""SELECT page_id, url, html, {path('url')} AS path, {host('url')} AS host,
    {language('url')} AS language, {section('url')} AS section, {base_name('url')} AS base_name,
    sha256(html) AS content_hash, {minutes('page_id')} AS fetched_at, {title('html')} AS title,
    {visible('html')} AS text FROM pages"""
PARTS["landed"] = f"""SELECT url, 'text/html; charset=utf-8' AS content_type, html, NULL AS body,
    {minutes('page_id')} AS fetched_at FROM pages
  UNION ALL SELECT 'https://files.example.com/' || lang || '/' || source || '/' || doc_id || '.pdf',
    'Application/PDF; v=1', NULL, text, {minutes('doc_id')} FROM documents
  UNION ALL SELECT 'https://img.example.com/' || label || '/' || vec_id || '.PNG', 'image/png', NULL,
    vec_id::VARCHAR, {minutes('vec_id')} FROM embeddings"""
PARTS["asset_pages"] = """SELECT page_id, url, html || '<img src="/img/' || language || '.png?v=1">'
    || '<img data-src="b.jpg"><source srcset="/s/' || page_id || '.webp 2x"><a href="/d/' || section
    || '.pdf?x=1#p2">pdf</a><a href="https://other.test/x.pdf">other</a>' AS html FROM pg"""
PARTS["manifest"] = f"""SELECT 'pages' AS container, base_name || '.html' AS name, base_name,
    CASE WHEN contains(url, '?') THEN reverse(content_hash) ELSE content_hash END AS content_hash,
    {days('page_id')} AS modified_at,
    CASE WHEN suffix(url, '/') THEN {days('page_id')} END AS deleted_at
    FROM pg WHERE NOT contains(url, '#')"""
PARTS["snapshots"] = f"""SELECT 'snapshots' AS container, {blob('url', q('.png'))} AS name,
    {days('page_id')} AS modified_at, NULL::TIMESTAMP AS deleted_at
    FROM pages WHERE {extension('url')} = '.html'"""
PARTS["stored"] = """SELECT container, name, modified_at, deleted_at FROM manifest
    UNION ALL SELECT container, name, modified_at, deleted_at FROM snapshots"""
PARTS["docs_src"] = f"""SELECT 'doc-' || doc_id AS parent_id, split_part(text, chr(10), 1) AS title,
    'https://docs.example.com/' || lang || '/' || source || '/' || doc_id || '.html' AS source_url,
    lang AS language, source AS section, 'doc' AS kind, {minutes('doc_id')} AS crawled_at,
    sha256(text) AS content_hash, text AS content FROM documents"""
PARTS["pages_src"] = """SELECT 'page-' || base_name AS parent_id, title, url AS source_url, language,
    section, 'page' AS kind, fetched_at AS crawled_at, content_hash, text AS content FROM pg"""
PARTS["asset_src"] = f"""SELECT 'asset-' || sha256(url) AS parent_id,
    regexp_extract(url, '[^/]*$') AS title, url AS source_url, {language('url')} AS language,
    NULL::VARCHAR AS section, 'doc' AS kind, fetched_at AS crawled_at, sha256(body) AS content_hash,
    body AS content FROM landed WHERE content_type = 'Application/PDF; v=1'"""
PARTS["all_src"] = """SELECT * FROM docs_src UNION ALL SELECT * FROM pages_src
    UNION ALL SELECT * FROM asset_src"""
PARTS["ocr"] = """SELECT 'doc-' || c.conv_id AS parent_id, d.n_chars * c.turn // 9 AS off, c.turn AS ord,
    c.text FROM conversations c JOIN documents d ON d.doc_id = c.conv_id"""
PARTS["asked"] = f"""SELECT item_id AS qid, regexp_replace(text, {q('^' + WHITESPACE + '|' + WHITESPACE + '$')}, '', 'g') AS q,
    CASE WHEN contains(text, ' the ') THEN 'en' END AS language, 20 AS top,
    CASE WHEN contains(text, chr(10)) THEN 60 ELSE 0 END AS skip FROM benchmark"""
PARTS["blank"] = """SELECT -1 - min(doc_id) AS qid, lang AS language, 20 AS top, 0 AS skip
    FROM documents GROUP BY lang"""
PARTS["robots"] = """SELECT DISTINCT host, 'https://' || host || '/sitemap.xml' AS loc FROM pg"""

# -- sources and sinks ---------------------------------------------------------

RESULTS["scan_landed"] = """SELECT url, content_type, length(html) AS html_chars,
    strlen(body) AS body_bytes FROM landed"""
RESULTS["robots_sitemaps"] = "SELECT host, loc FROM robots"
_LASTMOD = "CASE WHEN NOT contains(url, '#') THEN strftime(fetched_at, '%Y-%m-%d') END"
RESULTS["sitemap_entries"] = f"""SELECT 'https://' || host || '/sitemap-' || page_id // 1000 || '.xml' AS sitemap,
    url AS loc, {_LASTMOD} AS lastmod FROM pg"""
RESULTS["sitemap_expand"] = f"SELECT url AS loc, max({_LASTMOD}) AS lastmod FROM pg GROUP BY url"
RESULTS["page_dedup"] = RESULTS["sitemap_expand"]
RESULTS["scan_manifest"] = "SELECT base_name, content_hash FROM manifest"
RESULTS["sink_route"] = """SELECT parent_id, kind, CASE kind WHEN 'page' THEN 'pages' WHEN 'image' THEN 'images'
    WHEN 'snapshot' THEN 'snapshots' ELSE 'docs' END AS container FROM (
    SELECT parent_id, kind FROM docs_src UNION ALL SELECT parent_id, kind FROM pages_src
    UNION ALL SELECT 'chat-' || conv_id || '-' || turn, role FROM conversations)"""
PARTS["shots"] = f"""SELECT url, 'snapshot' AS kind, fetched_at, {language('url')} AS language, url AS body,
    CASE WHEN contains(url, '?') THEN 'application/pdf' ELSE 'image/png' END AS content_type FROM pages
    JOIN (SELECT url, fetched_at FROM pg) USING (url)"""
PARTS["binaries"] = f"""SELECT url, CASE WHEN content_type = 'image/png' THEN 'image' ELSE 'doc' END AS kind,
    fetched_at, {language('url')} AS language, body, split_part(lower(content_type), ';', 1) AS content_type,
    {blob('url')} AS name FROM landed WHERE body IS NOT NULL
  UNION ALL SELECT url, kind, fetched_at, language, body, content_type,
    CASE WHEN content_type = 'image/png' THEN {blob('url', q('.png'))} ELSE {blob('url', q('.pdf'))} END FROM shots"""
RESULTS["sink_binary"] = f"""SELECT kind || 's' AS container, name, content_type, strlen(body) AS n_bytes,
    sha256(body) AS data_hash, url_encode(url) AS sourceurl,
    {header_safe("regexp_extract(name, '[^/]*$')")} AS title, language,
    url_encode({iso('fetched_at')}) AS crawledat, sha256(body) AS contenthash, kind FROM binaries"""
PARTS["bundle"] = f"""SELECT 'pages' AS container, base_name || x.ext AS name, x.content_type, x.data,
    url_encode(url) AS sourceurl, {header_safe('title')} AS title, language,
    url_encode({iso('fetched_at')}) AS crawledat, content_hash AS contenthash, 'page' AS kind
  FROM (SELECT pg.*, main.markdown FROM pg JOIN main USING (url)), LATERAL (SELECT unnest([
    {{'ext': '.html', 'content_type': 'text/html; charset=utf-8', 'data': html}},
    {{'ext': '.md', 'content_type': 'text/markdown; charset=utf-8', 'data': markdown}},
    {{'ext': '.json', 'content_type': 'application/json; charset=utf-8', 'data': json_object(
      'sourceUrl', url, 'title', title, 'language', language, 'section', section,
      'contentHash', content_hash, 'crawledAt', {iso('fetched_at')}, 'lastmod', NULL)::VARCHAR}}]) AS x)"""
RESULTS["sink_page_bundle"] = """SELECT container, name, content_type, strlen(data) AS n_bytes,
    sha256(data) AS data_hash, sourceurl, title, language, crawledat, contenthash, kind FROM bundle"""
PARTS["names"] = """SELECT container, name FROM bundle
    UNION ALL SELECT kind || 's', name FROM binaries WHERE kind <> 'snapshot'"""
RESULTS["scan_by_extension"] = r"""SELECT container, name FROM names WHERE
    (container = 'pages' AND regexp_matches(name, '(?i)[^/.][^/]*\.md$'))
    OR (container = 'docs' AND regexp_matches(name, '(?i)[^/.][^/]*\.pdf$'))
    OR (container = 'images' AND regexp_matches(name, '(?i)[^/.][^/]*\.(png|jpe?g|bmp|tiff|gif)$'))"""
PARTS["restored"] = f"""SELECT container, name, data FROM bundle WHERE regexp_matches(name, '(?i)[^/.][^/]*\\.md$')
    UNION ALL SELECT kind || 's', name, CASE WHEN language = 'en' THEN url ELSE body END FROM binaries
      WHERE kind <> 'snapshot' AND regexp_matches(name, '(?i)[^/.][^/]*\\.(pdf|png|jpe?g|bmp|tiff|gif)$')"""
RESULTS["artifact_store"] = "SELECT container, name, strlen(data) AS n_bytes, sha256(data) AS data_hash FROM restored"
RESULTS["sink_upsert"] = """SELECT container, name, content_hash, modified_at FROM (
    SELECT *, row_number() OVER (PARTITION BY container, name ORDER BY src DESC, modified_at DESC) AS n FROM (
      SELECT container, name, content_hash, modified_at, 0 AS src FROM manifest
      UNION ALL SELECT 'pages', base_name || '.html', content_hash, fetched_at, 1 FROM pg
      UNION ALL SELECT 'pages', base_name || '.html', reverse(content_hash), fetched_at - INTERVAL 1 HOUR, 1 FROM pg))
    WHERE n = 1"""
RESULTS["union_sources"] = """SELECT parent_id, title, source_url, language, section, kind, content_hash,
    length(content) AS n_chars FROM all_src"""

# -- scalar functions ----------------------------------------------------------

for _key, _sql in {
    "url_path": path("url"), "url_host": host("url"), "language_from_url": language("url"),
    "section_from_url": section("url"), "blob_name": blob("url"), "page_base_name": base_name("url"),
    "snapshot_name": blob("url", q(".png")), "percent_encode": "url_encode(url)",
    "url_extension": extension("url"), "media_type": "split_part(lower(content_type), ';', 1)",
    "binary_kind": "CASE WHEN content_type LIKE 'image/%' THEN 'image' ELSE 'doc' END",
    "content_hash": "sha256(coalesce(html, body))",
}.items():
    RESULTS[_key] = f"SELECT url, {_sql} AS value FROM landed"
RESULTS["header_safe"] = f"SELECT doc_id, {header_safe('text')} AS value FROM documents"
RESULTS["text_direction"] = r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'rtl'
    ELSE 'ltr' END AS value FROM documents"""
RESULTS["percent_decode"] = """SELECT parent_id, 'raw' AS form, url_decode(content) AS value FROM docs_src
    UNION ALL SELECT parent_id, 'encoded', content FROM docs_src"""
RESULTS["url_join"] = f"""SELECT url, ref, {join_ref('url', 'ref')} AS value FROM (SELECT url, unnest(list_distinct(
    regexp_extract_all(html, '(?:href|src|data-src|srcset)="([^"]*)"', 1))) AS ref FROM asset_pages)"""

# -- extraction ----------------------------------------------------------------

RESULTS["html_gate"] = """SELECT url, CASE WHEN contains(content_type, 'text/html') THEN 'page' ELSE 'binary' END
    AS way FROM landed"""
RESULTS["page_title"] = "SELECT page_id, title FROM pg"
RESULTS["visible_text"] = "SELECT page_id, text FROM pg"
PARTS["markup"] = f"SELECT url, regexp_replace(html, {q(NOISE)}, ' ', 'g') AS m FROM asset_pages"
PARTS["img"] = f"""SELECT DISTINCT url AS source_page, {join_ref('url', 'ref')} AS asset_url FROM (
    SELECT url, split_part(split_part(unnest(list_concat({attribute('m', 'img', 'src')},
      {attribute('m', 'img', 'data-src')}, {attribute('m', 'source', 'srcset')})), ' ', 1), '?', 1) AS ref
    FROM markup)"""
PARTS["doc"] = f"""SELECT DISTINCT url AS source_page, {join_ref('url', 'ref')} AS asset_url FROM (
    SELECT url, split_part(unnest({attribute('m', 'a', 'href')}), '?', 1) AS ref FROM markup)"""
RESULTS["image_refs"] = "SELECT source_page, asset_url FROM img"
RESULTS["doc_refs"] = "SELECT source_page, asset_url FROM doc"


def _is_asset(extensions: tuple[str, ...]) -> str:
    bare = "lower(split_part(asset_url, '#', 1))"
    ends = " OR ".join(f"suffix({path(bare)}, '{e}')" for e in extensions)
    hosts = " OR ".join(f"{host(bare)} = '{h}' OR suffix({host(bare)}, '.{h}')"
                        for h in ("example.com", "example.net", "example.org"))
    return f"({ends}) AND ({hosts})"


PARTS["assets"] = f"""SELECT source_page, asset_url, 'image' AS kind FROM img WHERE {_is_asset(IMAGE_EXTENSIONS)}
    UNION ALL SELECT source_page, asset_url, 'doc' FROM doc WHERE {_is_asset(DOC_EXTENSIONS)}"""
RESULTS["asset_filter"] = "SELECT source_page, asset_url, kind FROM assets"
RESULTS["asset_dedup"] = "SELECT asset_url, kind, min(source_page) AS source_page FROM assets GROUP BY ALL"
RESULTS["stream_asset_dedup"] = RESULTS["stream_unique_assets"] = "SELECT DISTINCT asset_url FROM assets"
PARTS["site"] = "SELECT *, regexp_extract(url, '^[^/]*//[^/?#]*', 0) AS home FROM pg"
PARTS["site_files"] = """SELECT home || '/img/' || language || '.png' AS url, 'image/png' AS content_type FROM site
    UNION SELECT home || '/s/' || page_id || '.webp', 'image/webp' FROM site
    UNION SELECT home || '/d/' || section || '.pdf', 'application/pdf' FROM site"""
PARTS["all_binaries"] = """SELECT url, content_type, url AS body FROM site_files
    UNION ALL SELECT url, content_type, body FROM landed WHERE body IS NOT NULL"""


def _linked(pages: str) -> str:
    return f"""SELECT b.url, b.body, lower(content_type) AS content_type, coalesce(l.source_page, b.url) AS source_page,
    coalesce(l.kind, CASE WHEN prefix(lower(content_type), 'image/') THEN 'image' ELSE 'doc' END) AS kind
  FROM all_binaries b LEFT JOIN (SELECT asset_url, source_page, kind FROM assets JOIN {pages} ON {pages}.url = source_page
    QUALIFY row_number() OVER (PARTITION BY asset_url ORDER BY source_page, kind <> 'image') = 1) l ON l.asset_url = b.url"""


PARTS["allowed_pages"] = """SELECT * FROM asset_pages JOIN (SELECT url, base_name, language, path, fetched_at FROM pg) USING (url)
    WHERE path NOT LIKE '/es/%' OR path LIKE '/es/5%'"""
PARTS["linked_all"], PARTS["linked_allowed"] = _linked("pg"), _linked("allowed_pages")
RESULTS["linked_assets"] = f"""SELECT url, kind, source_page, content_type, sha256(body) AS content_hash,
    {language('source_page')} AS language FROM linked_all"""
PARTS["crawled"] = f"""SELECT 'pages' AS container, base_name || ext AS name, sha256(html) AS content_hash,
    NULL::VARCHAR AS source_page, language, CASE WHEN ext = '.json' THEN {_LASTMOD} END AS lastmod, contains(url, '?') AS moves
  FROM allowed_pages, (VALUES ('.html'), ('.md'), ('.json')) e(ext)
  UNION ALL SELECT kind || 's', {blob('url')}, sha256(body), url_encode(source_page), {language('source_page')}, NULL::VARCHAR, false FROM linked_allowed"""
RESULTS["ingest_artifacts"] = "SELECT container, name, content_hash, source_page, language, lastmod FROM crawled"
RESULTS["run_manifest"] = """SELECT run::INTEGER AS run, c AS container, (SELECT count(*) FROM crawled
    WHERE container = c AND (run = 1 OR moves)) AS uploaded
  FROM (VALUES (1), (2)) r(run), (VALUES ('pages'), ('images'), ('docs'), ('snapshots')) k(c)"""
RESULTS["rendered_image_union"] = f"""SELECT asset_url, min(source_page) AS source_page FROM (
    SELECT source_page, asset_url FROM img
    UNION ALL SELECT url, 'https://cdn.example.com/r/' || section || '.png' FROM pg)
    WHERE {_is_asset(IMAGE_EXTENSIONS)} GROUP BY asset_url"""
RESULTS["asset_language"] = f"""SELECT asset_url AS url, source_page, {language('source_page')} AS language
    FROM assets"""
RESULTS["page_record"] = f"""SELECT url, base_name, title, language, section, content_hash,
    fetched_at AS crawled_at, host, {_LASTMOD} AS lastmod FROM pg"""


def _rewritten() -> str:
    t = "html"
    for pattern, replacement in REWRITES:
        replacement = re.sub(r"\{([12])\}", r"\\\1", replacement)
        t = f"regexp_replace({t}, {q(pattern)}, {q(replacement)}, 'g')"
    return t


PARTS["cut"] = f"SELECT url, host, string_split({_rewritten()}, chr(1)) AS parts FROM pg"
PARTS["block"] = f"""SELECT url, host, pos, b FROM (SELECT url, host, generate_subscripts(parts, 1) AS pos,
      unnest(list_transform(parts, lambda b: {flat(unescape('b'))})) AS b FROM cut)
    WHERE b NOT IN ('', '-', '|') AND NOT regexp_matches(b, '^{HEADING}[1-6] ?$')"""
PARTS["md"] = f"""SELECT url, host, pos, translate(CASE WHEN starts_with(b, '{HEADING}')
      THEN repeat('#', substr(b, 2, 1)::INTEGER) || ' ' || regexp_replace(b, '^{HEADING}[1-6] ?', '')
      ELSE b END, '{LINK_OPEN}{LINK_CLOSE}', '[]') AS md
    FROM block WHERE length(array_to_string(regexp_extract_all(b, '{LINK_OPEN}([^{LINK_CLOSE}]*){LINK_CLOSE}', 1), ''))
      / greatest(length(regexp_replace(b, '{LINK_CLOSE}\\([^)]*\\)|{LINK_OPEN}|^- |^{HEADING}[1-6]', '', 'g')), 1) <= 0.5"""
PARTS["repeats"] = """SELECT host, md FROM (SELECT host, md, count(DISTINCT url) AS n FROM md GROUP BY ALL)
    JOIN (SELECT host, count(*) AS total FROM pg GROUP BY host) USING (host)
    WHERE n >= 3 AND n >= total * 0.5"""
PARTS["main"] = """SELECT url, coalesce(markdown, '') AS markdown FROM pg LEFT JOIN (
      SELECT url, string_agg(md, chr(10) || chr(10) ORDER BY pos) AS markdown
      FROM md ANTI JOIN repeats USING (host, md) GROUP BY url) USING (url)"""
RESULTS["main_content"] = "SELECT url, markdown FROM main"

# -- filters -------------------------------------------------------------------

PARTS["allowed"] = "SELECT DISTINCT host AS h FROM pg WHERE starts_with(url, 'https:')"
RESULTS["allowed_domains"] = """SELECT page_id, url FROM pg
    WHERE EXISTS (SELECT 1 FROM allowed WHERE host = h OR suffix(host, '.' || h))"""
RESULTS["robots_allowed"] = "SELECT page_id, url FROM pg WHERE path NOT LIKE '/es/%' OR path LIKE '/es/5%'"
RESULTS["facet_filter"] = "SELECT parent_id, language, section, kind FROM docs_src WHERE language = 'en'"
RESULTS["query_bounds"] = """SELECT conv_id * 100 + turn AS qid, (turn * 9)::INTEGER AS top,
    (conv_id * 11 - 1)::INTEGER AS skip, CASE WHEN length(text) > 1000 THEN 'q too long'
      WHEN turn * 9 NOT BETWEEN 1 AND 50 THEN 'top out of range'
      WHEN conv_id * 11 - 1 NOT BETWEEN 0 AND 1000 THEN 'skip out of range' END AS error FROM conversations"""
RESULTS["nonempty_chunks"] = """SELECT parent_id || '-' || line || '_' || i AS id,
    length(substr(t, i * 1500 + 1, 2000)) AS n_chars FROM (
      SELECT parent_id, line, t, unnest(range(greatest(ceil((length(t) - 500) / 1500), 1)::BIGINT)) AS i FROM (
        SELECT parent_id, unnest(string_split(content, chr(10))) AS t,
          generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM docs_src)) WHERE t <> ''"""

# -- incremental ---------------------------------------------------------------

RESULTS["changed_pages"] = """SELECT url, base_name, content_hash FROM pg
    ANTI JOIN manifest USING (base_name, content_hash)"""
RESULTS["stream_changed_pages"] = RESULTS["changed_pages"].replace("SELECT url, base_name", "SELECT base_name, url")
RESULTS["changed_artifacts"] = """SELECT 'pages' AS container, base_name || ext AS name FROM pg,
    (VALUES ('.html'), ('.md'), ('.json')) e(ext) WHERE NOT EXISTS (SELECT 1 FROM manifest m
      WHERE m.name = pg.base_name || '.html' AND m.content_hash = pg.content_hash)"""
PARTS["classed"] = """SELECT p.base_name, p.content_hash, CASE WHEN m.base_name IS NULL THEN 'new'
    WHEN m.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS change_class
    FROM pg p LEFT JOIN manifest m USING (base_name)"""
RESULTS["change_class"] = "SELECT base_name, content_hash, change_class FROM classed"
RESULTS["run_counters"] = """SELECT 'pages' AS container, change_class, CASE change_class WHEN 'unchanged'
    THEN 'skipped' ELSE 'uploaded' END AS outcome, count(*) AS n FROM classed GROUP BY ALL"""
RESULTS["snapshot_expiry"] = f"""SELECT container, name, modified_at FROM stored
    WHERE NOT (container = 'snapshots' AND modified_at < {NOW} - INTERVAL 30 DAY)"""
RESULTS["soft_delete"] = f"""SELECT container, name, deleted_at, deleted_at IS NOT NULL AS recoverable
    FROM stored WHERE deleted_at IS NULL OR deleted_at >= {NOW} - INTERVAL 7 DAY"""


def chunked(source: str, extra: str = "title, source_url, language, section, kind, content_hash, crawled_at") -> str:
    return f"""SELECT parent_id || '_' || i AS id, parent_id, i::INTEGER AS ord,
        substr(content, i * 1500 + 1, 2000) AS chunk, {extra} FROM (
          SELECT *, unnest(range(greatest(ceil((length(content) - 500) / 1500), 1)::BIGINT)) AS i FROM {source})
        WHERE content <> ''"""


PARTS["doc_chunks"] = chunked("docs_src")
PARTS["page_chunks"] = chunked("pages_src")
PARTS["changed_src"] = "SELECT * REPLACE (replace(content, ' ', '_') AS content) FROM docs_src WHERE language = 'en'"
PARTS["rebuilt"] = chunked("changed_src")
RESULTS["deletion_detect"] = """SELECT id, parent_id FROM page_chunks WHERE parent_id NOT IN (
    SELECT 'page-' || base_name FROM manifest WHERE deleted_at IS NOT NULL)"""
RESULTS["incremental_index"] = """SELECT id, parent_id, sha256(chunk) AS chunk_hash FROM (
    SELECT id, parent_id, chunk FROM doc_chunks WHERE language <> 'en'
    UNION ALL SELECT id, parent_id, chunk FROM rebuilt)"""
RESULTS["quarantine"] = """SELECT url, CASE WHEN url IS NULL THEN 'no url' WHEN NOT contains(url, '//') THEN 'no host'
      WHEN role <> 'user' THEN 'no content type' WHEN NOT contains(text, 'the') THEN 'no body' END AS error,
    count(*) AS n FROM (SELECT *, CASE WHEN role <> 'system' THEN 'chat:' || CASE WHEN turn > 1
      THEN '//chat.example.com' ELSE '' END || '/' || conv_id || '/' || turn END AS url FROM conversations)
    GROUP BY ALL"""
RESULTS["snapshot_lookup"] = f"""SELECT p.parent_id, p.source_url, s.name AS snapshot FROM pages_src p
    LEFT JOIN snapshots s ON s.name = {blob('p.source_url', q('.png'))}"""

# -- index build ---------------------------------------------------------------

PARTS["spliced"] = """SELECT parent_id, string_agg(part, '' ORDER BY off, ord) AS head, max(off) AS last FROM (
      SELECT parent_id, off, ord, substr(content, lag(off, 1, 0) OVER w + 1, off - lag(off, 1, 0) OVER w)
        || ' ' || text || ' ' AS part
      FROM ocr JOIN docs_src USING (parent_id) WINDOW w AS (PARTITION BY parent_id ORDER BY off, ord))
    GROUP BY parent_id"""
PARTS["merged"] = """SELECT d.* REPLACE (CASE WHEN s.head IS NULL THEN content
    ELSE s.head || substr(content, s.last + 1) END AS content)
    FROM (SELECT * FROM all_src) d LEFT JOIN spliced s USING (parent_id)"""
RESULTS["merge_inserts"] = "SELECT parent_id, content FROM merged WHERE parent_id LIKE 'doc-%'"
RESULTS["chunk_text"] = "SELECT id, parent_id, ord, chunk FROM doc_chunks"
_HASHED = "SELECT id, parent_id, ord, sha256(chunk) AS chunk_hash FROM doc_chunks"
RESULTS["sink_index"] = _HASHED
RESULTS["stream_index_refresh"] = _HASHED.replace("ord, ", "")
PARTS["sentence_cut"] = r"""SELECT parent_id, content, 0 AS ord, 0 AS pos, cut FROM (SELECT parent_id, content,
      CASE WHEN length(content) <= 2000 THEN length(content)
        WHEN length(regexp_extract(substr(content, 1, 2000), '(?s)^.*[.!?؟\n]')) > 1000
        THEN length(regexp_extract(substr(content, 1, 2000), '(?s)^.*[.!?؟\n]')) ELSE 2000 END AS cut FROM docs_src)
    UNION ALL
    SELECT parent_id, content, ord + 1, p, CASE WHEN p + 2000 >= length(content) THEN length(content) - p
        WHEN length(regexp_extract(substr(content, p + 1, 2000), '(?s)^.*[.!?؟\n]')) > 1000
        THEN length(regexp_extract(substr(content, p + 1, 2000), '(?s)^.*[.!?؟\n]')) ELSE 2000 END
    FROM (SELECT *, pos + cut - 500 AS p FROM sentence_cut WHERE pos + 2000 < length(content))"""
RESULTS["chunk_sentences"] = """SELECT parent_id || '_' || ord AS id, ord, substr(content, pos + 1, cut) AS chunk
    FROM sentence_cut"""


def hashed(source: str, key: str, text: str) -> str:
    """Unit vectors as rows (key, bucket, w)."""
    return f"""SELECT {key}, bucket, w, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS norm FROM (
        SELECT {key}, bucket, (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w FROM (
          SELECT {key}, bucket, sum(sign)::DOUBLE AS s FROM (
            SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 256 AS bucket,
              CASE WHEN substr(md5(t), 9, 1) >= '8' THEN -1 ELSE 1 END AS sign
            FROM (SELECT {key}, unnest({tokens(text)}) AS t FROM {source}))
          GROUP BY ALL HAVING sum(sign) <> 0))"""


PARTS["doc_vec"] = hashed("doc_chunks", "id", "chunk")
RESULTS["embed_hash"] = "SELECT id, bucket::INTEGER AS bucket, round(w, 6) AS weight FROM doc_vec"
RESULTS["embed_column"] = """SELECT id, len(embedding)::INTEGER AS dim,
    round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total
    FROM doc_chunks LEFT JOIN (SELECT 'doc-' || vec_id || '_0' AS id, embedding FROM embeddings) USING (id)"""
RESULTS["embed_udf"] = """SELECT id, length(chunk)::DOUBLE AS n_chars,
    (length(chunk) - length(replace(chunk, ' ', '')))::DOUBLE AS n_blanks,
    (length(chunk) - length(replace(chunk, chr(10), '')))::DOUBLE AS n_breaks FROM doc_chunks"""
PARTS["merged_chunks"] = chunked("merged")
RESULTS["embed_rejects"] = """SELECT id, CASE WHEN contains(chunk, chr(10)) THEN length(chunk)::DOUBLE END AS n_chars,
    CASE WHEN NOT contains(chunk, chr(10)) THEN 'ValueError: a single line' END AS error
    FROM merged_chunks"""
RESULTS["index_projection"] = """SELECT id, parent_id, ord, sha256(chunk) AS chunk_hash, title, source_url, language,
    section, kind, content_hash, 256 AS dim FROM merged_chunks"""


def tokenised(source: str) -> str:
    return f"""SELECT id, language, section, kind, 'chunk' AS field, unnest({tokens('chunk')}) AS term FROM {source}
      UNION ALL SELECT id, language, section, kind, 'title', unnest({tokens('title')}) FROM {source}
      UNION ALL SELECT id, language, section, kind, 'id', id FROM {source}"""


PARTS["doc_tok"] = tokenised("doc_chunks")
RESULTS["analyze_text"] = "SELECT field, term, count(*) AS n FROM doc_tok GROUP BY ALL"
RESULTS["build_postings"] = """SELECT id, field, term, count(*)::INTEGER AS tf,
    (sum(count(*)) OVER (PARTITION BY id, field))::INTEGER AS dl FROM doc_tok GROUP BY id, field, term"""
RESULTS["term_frequencies"] = "SELECT field, term, count(DISTINCT id) AS df FROM doc_tok GROUP BY ALL"
RESULTS["corpus_stats"] = """SELECT field, count(*) AS n, round(avg(dl), 6) AS avgdl FROM (
    SELECT id, field, count(*) AS dl FROM doc_tok GROUP BY ALL) GROUP BY field"""

# -- retrieval -----------------------------------------------------------------

PARTS["ix_chunks"] = """SELECT * FROM doc_chunks UNION ALL SELECT * FROM page_chunks"""
PARTS["ix_tok"] = tokenised("ix_chunks")
PARTS["ix_post"] = """SELECT *, sum(tf) OVER (PARTITION BY id, field) AS dl FROM (
    SELECT id, language, section, kind, field, term, count(*) AS tf FROM ix_tok GROUP BY ALL)"""
PARTS["ix_df"] = "SELECT field, term, count(*) AS df FROM ix_post GROUP BY ALL"
PARTS["ix_stats"] = """SELECT field, count(*) AS n, avg(dl) AS avgdl FROM (
    SELECT DISTINCT id, field, dl FROM ix_post) GROUP BY field"""
PARTS["q_terms"] = f"""SELECT qid, language AS want, field, term, count(*) AS qtf FROM (
      SELECT qid, language, 'chunk' AS field, unnest({tokens('q')}) AS term FROM asked
      UNION ALL SELECT qid, language, 'title', unnest({tokens('q')}) FROM asked
      UNION ALL SELECT qid, language, 'id', q FROM asked) GROUP BY ALL"""
PARTS["q_weights"] = """SELECT *, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM q_terms
    JOIN ix_df USING (field, term) JOIN ix_stats USING (field)"""
PARTS["scores"] = """SELECT qid, id, p.language, section, kind, round(sum(idf * qtf * tf * 2.2
      / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM q_weights JOIN ix_post p USING (field, term) WHERE want IS NULL OR want = p.language GROUP BY ALL"""
PARTS["text_rank"] = """SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank
    FROM scores"""
RESULTS["bm25_topk"] = "SELECT qid, id, score, rank::INTEGER AS rank FROM text_rank WHERE rank <= 50"
RESULTS["bm25_by_term"] = RESULTS["bm25_topk"]
PARTS["ix_vec"] = hashed("ix_chunks", "id", "chunk")
PARTS["q_vec"] = hashed("asked", "qid", "q")
PARTS["near"] = """SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
      SELECT qid, id, round(coalesce(s, 0), 6) AS score FROM (SELECT DISTINCT qid, id FROM
        (SELECT DISTINCT qid FROM q_vec) JOIN (SELECT qid, coalesce(language, 'any') AS want FROM asked) USING (qid)
        JOIN (SELECT DISTINCT id, unnest([language, 'any']) AS want FROM ix_vec JOIN (SELECT id, language FROM ix_chunks) USING (id))
          USING (want))
      LEFT JOIN (SELECT qid, id, sum((a.w / a.norm) * (b.w / b.norm)) AS s FROM q_vec a
        JOIN ix_vec b USING (bucket) GROUP BY ALL) USING (qid, id))
    QUALIFY rank <= 50"""
RESULTS["knn_all_cells"] = """SELECT a.vec_id AS qid, b.vec_id::VARCHAR AS id, round(list_dot_product(
      a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
      / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score,
    (row_number() OVER (PARTITION BY qid ORDER BY score DESC, b.vec_id::VARCHAR))::INTEGER AS rank
    FROM embeddings a, embeddings b QUALIFY rank <= 10"""
PARTS["unit"] = """SELECT vec_id, list_transform(embedding::DOUBLE[],
      lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings"""
PARTS["centres"] = """SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) AS cell, v AS c FROM unit QUALIFY cell <= 20"""
PARTS["near_cells"] = """SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id
      ORDER BY list_dot_product(c, c) - 2 * list_dot_product(v, c), cell) AS r FROM unit CROSS JOIN centres"""
RESULTS["knn_approx"] = """SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INTEGER AS rank
    FROM (SELECT a.vec_id AS qid, b.vec_id::VARCHAR AS id, round(list_dot_product(x.v, y.v), 6) AS score
      FROM near_cells a JOIN near_cells b ON a.cell = b.cell AND a.r <= 15 AND b.r = 1
      JOIN unit x ON x.vec_id = a.vec_id JOIN unit y ON y.vec_id = b.vec_id) QUALIFY rank <= 10"""
RESULTS["knn_exact"] = "SELECT qid, id, score, rank::INTEGER AS rank FROM near"
PARTS["fused"] = """SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
      SELECT qid, id, round(sum(1 / (60 + rank)), 9) AS score FROM (
        SELECT qid, id, rank FROM text_rank UNION ALL SELECT qid, id, rank FROM near) GROUP BY ALL)
    QUALIFY rank <= 1050"""
RESULTS["hybrid_rrf"] = "SELECT qid, id, score, rank::INTEGER AS rank FROM fused"
RESULTS["hybrid_cells"] = RESULTS["hybrid_rrf"]
RESULTS["facet_counts"] = """SELECT qid, field, value, n AS count FROM (
    SELECT qid, field, value, count(*) AS n,
      row_number() OVER (PARTITION BY qid, field ORDER BY count(*) DESC, value) AS r FROM (
        SELECT qid, 'language' AS field, language AS value FROM scores
        UNION ALL SELECT qid, 'section', section FROM scores UNION ALL SELECT qid, 'kind', kind FROM scores)
    GROUP BY qid, field, value) WHERE r <= 20"""
PARTS["everything"] = """SELECT qid, c.id, 1.0::DOUBLE AS score,
    row_number() OVER (PARTITION BY qid ORDER BY c.id) AS rank FROM blank JOIN ix_chunks c USING (language)"""
RESULTS["match_all"] = "SELECT qid, id, score, rank::INTEGER AS rank FROM everything WHERE rank <= 1050"

# Second stage over the fused head: idf share of passage, best sentence, title.
PARTS["head"] = """SELECT f.qid, f.id, f.rank, f.score, c.chunk, c.title FROM fused f JOIN ix_chunks c USING (id)
    WHERE f.rank <= 50"""
PARTS["q_idf"] = "SELECT qid, term, idf, sum(idf) OVER (PARTITION BY qid) AS total FROM q_weights WHERE field = 'chunk'"
PARTS["units"] = f"""SELECT qid, id, 'chunk' AS what, 0 AS ord, chunk AS text FROM head
    UNION ALL SELECT qid, id, 'title', 0, coalesce(title, '') FROM head
    UNION ALL SELECT qid, id, 'sentence', generate_subscripts(s, 1), unnest(s) FROM (
      SELECT qid, id, {sentences('chunk')} AS s FROM head)"""
PARTS["covers"] = f"""SELECT u.qid, u.id, u.what, u.ord, any_value(u.text) AS text,
    coalesce(sum(idf) / any_value(total), 0) AS cover
    FROM (SELECT *, unnest(CASE WHEN text = '' THEN [''] ELSE list_distinct(list_append({tokens('text')}, '')) END) AS term
      FROM units) u LEFT JOIN q_idf USING (qid, term) GROUP BY u.qid, u.id, u.what, u.ord"""
PARTS["best_sentence"] = """SELECT qid, id, round(cover, 6) AS cover, text FROM covers WHERE what = 'sentence'
    QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY round(cover, 6) DESC, ord) = 1"""
PARTS["second"] = """SELECT h.qid, h.id, h.rank, h.score, round(2.0 * c.cover + 1.2 * coalesce(b.cover, 0)
      + 0.8 * t.cover, 6) AS reranker, b.text AS caption, b.cover AS caption_score
    FROM head h JOIN (SELECT * FROM covers WHERE what = 'chunk') c USING (qid, id)
    JOIN (SELECT * FROM covers WHERE what = 'title') t USING (qid, id) LEFT JOIN best_sentence b USING (qid, id)"""
PARTS["final"] = """SELECT qid, id, score, reranker, caption, caption_score,
      row_number() OVER (PARTITION BY qid ORDER BY reranker DESC, id) AS rn FROM second
    UNION ALL SELECT qid, id, score, NULL, NULL, NULL, rank FROM fused WHERE rank > 50"""
RESULTS["rerank"] = "SELECT qid, id, rn::INTEGER AS rn, reranker FROM final"
RESULTS["captions"] = "SELECT qid, id, caption, caption_score FROM second"
RESULTS["answers"] = """SELECT qid, 1 AS answer_rank, caption AS text, caption_score AS score FROM final
    WHERE caption <> ''
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY caption_score DESC, id) = 1"""

# -- shaping -------------------------------------------------------------------

PARTS["paged"] = """SELECT qid, id, score, rank AS rn FROM text_rank JOIN asked USING (qid)
    WHERE rank > skip AND rank <= skip + top"""
RESULTS["page_slice"] = "SELECT qid, id, rn::INTEGER AS rn FROM paged"


def collapsed(rows: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_rn) AS pos FROM (
        SELECT *, min(rn) OVER (PARTITION BY qid, parent_id) AS first_rn,
          row_number() OVER (PARTITION BY qid, parent_id ORDER BY coalesce(reranker, 0) DESC, rn) AS best
        FROM {rows}) WHERE best = 1"""


def card(rows: str) -> str:
    return f"""SELECT qid, pos::INTEGER AS pos, parent_id,
        coalesce(nullif(url_decode(coalesce(title, '')), ''), '(untitled)') AS title,
        url_decode(source_url) AS source_url, language, section, kind, {iso('crawled_at')} AS crawled_at,
        score, reranker, caption, substr(chunk, 1, 400) AS snippet FROM {rows}"""


PARTS["text_page"] = f"""SELECT p.qid, p.rn, p.score, floor(p.score)::DOUBLE AS reranker, c.*,
    CASE WHEN c.language = 'en' THEN ({sentences('c.chunk')})[1] END AS caption
    FROM paged p JOIN ix_chunks c USING (id)"""
PARTS["text_cards"] = collapsed("text_page")
RESULTS["collapse_parent"] = """SELECT qid, pos::INTEGER AS pos, parent_id, id, rn::INTEGER AS rn, reranker
    FROM text_cards"""
RESULTS["result_card"] = card("text_cards")
RESULTS["display_text"] = """SELECT qid, pos::INTEGER AS pos, coalesce(nullif(caption, ''),
    nullif(substr(chunk, 1, 400), '')) AS text, round(reranker, 2) AS score FROM text_cards"""
#: The same chain with five neighbours instead of fifty.
PARTS["near_five"] = "SELECT * FROM near WHERE rank <= 5"
_CHAIN = ["fused", "head", "units", "covers", "best_sentence", "second", "final"]
for _name in _CHAIN:
    PARTS[f"{_name}_five"] = re.sub(rf"\b(FROM|JOIN) ({'|'.join([*_CHAIN, 'near'])})\b", r"\1 \2_five", PARTS[_name])
RESULTS["cli_rows"] = f"""SELECT qid, rn::INTEGER AS rn, reranker, score, language, kind,
    url_decode(coalesce(title, '')) AS title, url_decode(source_url) AS source_url,
    substr({flat('chunk')}, 1, 160) AS snippet FROM final_five JOIN ix_chunks USING (id) WHERE rn <= 5"""
PARTS["listed"] = """SELECT qid, id, score, reranker, caption, rn, skip, top FROM final JOIN asked USING (qid)
    UNION ALL SELECT qid, id, score, NULL, NULL, rank, skip, top FROM everything JOIN blank USING (qid)"""
PARTS["full_page"] = """SELECT p.qid, p.rn, p.score, p.reranker, p.caption, c.* FROM listed p
    JOIN ix_chunks c USING (id) WHERE p.rn > p.skip AND p.rn <= p.skip + p.top"""
PARTS["full_cards"] = collapsed("full_page")
RESULTS["search_response"] = card("full_cards")
PARTS["by_parent"] = """SELECT *, min(rn) OVER (PARTITION BY qid, parent) AS first_rn,
      row_number() OVER (PARTITION BY qid, parent ORDER BY coalesce(reranker, 0) DESC, rn) AS best
    FROM (SELECT *, regexp_replace(id, '_[0-9]+$', '') AS parent FROM listed WHERE rn <= 1050)"""
PARTS["listed_first"] = """SELECT qid, id, score, reranker, caption, skip, top,
      row_number() OVER (PARTITION BY qid ORDER BY first_rn) AS rn FROM by_parent WHERE best = 1"""
PARTS["first_page"] = PARTS["full_page"].replace("FROM listed", "FROM listed_first")
PARTS["first_cards"] = collapsed("first_page")
RESULTS["search_collapsed"] = card("first_cards")
PARTS["candidates"] = """SELECT DISTINCT qid, c.id, c.language, c.section, c.kind FROM (
      SELECT qid, id FROM scores UNION ALL SELECT qid, id FROM near UNION ALL SELECT qid, id FROM everything)
    JOIN ix_chunks c USING (id)"""
RESULTS["search_facets"] = RESULTS["facet_counts"].replace("FROM scores", "FROM candidates")
