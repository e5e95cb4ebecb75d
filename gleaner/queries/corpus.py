"""Scanning, parsing, identity, chunking and filter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions import text as X, urls as U
from gleaner.operators import chunking, extract, filters, identity
from gleaner.queries import Queries, table
from gleaner.session import spread
from gleaner.sources import files

ALL = Queries()

NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""
HASH = "sha256(" + NORM.format("text") + ")"


def rank_sql(u: str) -> str:
    return f"(CASE WHEN contains(regexp_replace({u}, '#.*$', ''), '?') THEN 1 ELSE 0 END, length({u}), {u})"


def sid(kind: str, *parts: str) -> str:
    return f"'gl_{kind}_' || substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 24)"


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


#: Rows that real tables seldom have: a text that is not composed beside its composed twin, and empty ones.
AWKWARD = [(-1, "made", "e\u0301te\u0301 \r\nfin"), (-2, "made", "\u00e9t\u00e9\nfin"), (-3, "made", " \n\t"), (-4, "made", ""), (-5, "made", None)]
AWKWARD_SQL = "d AS (SELECT doc_id, source, text FROM documents UNION ALL VALUES (-1, 'made', 'e' || chr(769) || 'te' || chr(769) || ' ' || chr(13) || chr(10) || 'fin'), (-2, 'made', chr(233) || 't' || chr(233) || chr(10) || 'fin'), (-3, 'made', ' ' || chr(10) || chr(9)), (-4, 'made', ''), (-5, 'made', NULL))"


@ALL.add(f"""WITH {AWKWARD_SQL}, h AS (SELECT doc_id, source, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10)) = '' THEN 'empty:' || CAST(doc_id AS VARCHAR) ELSE {HASH} END AS content_hash FROM d),
g AS (SELECT source, content_hash, min(doc_id) AS first_id, count(*) AS n_aliases FROM h GROUP BY ALL)
SELECT h.doc_id, h.content_hash, {sid('document', 'source', "CAST(first_id AS VARCHAR)")} AS document_id, n_aliases, h.doc_id = first_id AS is_owner FROM h JOIN g USING (source, content_hash)""")
def content_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text")).unionByName(spark.createDataFrame(AWKWARD, "doc_id long, source string, text string").coalesce(1))
    files = d.select(F.col("source").alias("corpus_id"), F.col("doc_id").cast("string").alias("uri"), F.col("doc_id").alias("seq"), "text")
    return identity.content_documents(files).select(F.col("seq").alias("doc_id"), "content_hash", "document_id", "n_aliases", "is_owner")


@ALL.add(f"SELECT doc_id, {sid('revision', 'CAST(doc_id AS VARCHAR)', HASH)} AS revision_id, sha256(text) AS text_hash FROM documents")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.stable_id("revision", "doc_id", X.content_hash("text")).alias("revision_id"), X.text_hash("text").alias("text_hash"))


@ALL.add(f"""WITH r AS (SELECT {HOST} AS host, min({rank_sql('url')}) AS best, count(*) AS n FROM pages GROUP BY 1)
SELECT host, best[3] AS primary_uri, n AS n_aliases FROM r""".replace("best[3]", "struct_extract(best, 3)"))
def alias_primary_uri(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(U.site_host("url").alias("host"), F.col("url").alias("uri"))
    return identity.primary_alias(p, "host")


@ALL.add(f"""WITH a AS (SELECT {HOST} AS host, url, {rank_sql('url')} AS r FROM pages), d AS (SELECT host, min(r) AS best FROM a GROUP BY 1),
l AS (SELECT a.host, a.url, a.r, a.r <> d.best AS live FROM a JOIN d USING (host))
SELECT host, struct_extract(min(r) FILTER (live), 3) AS primary_uri, count(*) FILTER (live) AS n_live, count(*) FILTER (live) = 0 AS deleted FROM l GROUP BY 1""")
def soft_delete_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """The primary alias of every host is deleted; the next one is promoted."""
    p = table(spark, sf, "pages").select(U.site_host("url").alias("host"), F.col("url").alias("uri"))
    return identity.after_deletion(p, identity.primary_alias(p, "host").select(F.col("primary_uri").alias("uri")), "host")


@ALL.add("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT user_id, event_type, day, CAST(n AS VARCHAR) AS content, CAST(round(v, 4) AS VARCHAR) AS raw FROM d),
b AS (SELECT user_id, event_type, day + INTERVAL 1 DAY AS day, content, raw FROM s)
SELECT coalesce(b.user_id, s.user_id) AS user_id, coalesce(b.event_type, s.event_type) AS event_type, CAST(coalesce(b.day, s.day) AS DATE) AS day,
CASE WHEN b.user_id IS NULL THEN 'added' WHEN s.user_id IS NULL THEN 'deleted' WHEN b.content <> s.content THEN 'content_changed' WHEN b.raw <> s.raw THEN 'metadata_only' ELSE 'unchanged' END AS status
FROM b FULL JOIN s ON b.user_id = s.user_id AND b.event_type = s.event_type AND CAST(b.day AS DATE) = s.day""")
def snapshot_diff_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Daily snapshots by user and event type; each day against the day before."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).cast("string").alias("raw"), F.count(F.lit(1)).cast("string").alias("content"))
    return identity.observations(e.withColumn("day", F.date_add("day", 1)), e, ["user_id", "event_type", "day"])


@ALL.add(f"""WITH r AS (SELECT CAST(conv_id AS VARCHAR) || ':' || role AS document_id, {HASH} AS content_hash, turn AS seq FROM conversations),
s AS (SELECT document_id, content_hash, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY ALL),
l AS (SELECT document_id, max(last_seq) AS c FROM s GROUP BY 1)
SELECT {sid('revision', 'document_id', 'content_hash')} AS revision_id, document_id, content_hash, first_seq, last_seq = c AS is_current FROM s JOIN l USING (document_id)""")
def revision_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return identity.revisions(c.select(F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("document_id"), X.content_hash("text").alias("content_hash"), F.col("turn").alias("seq")))


@ALL.add(f"""WITH h AS (SELECT doc_id, {HASH} AS h, len(string_split(text, chr(10))) AS sections FROM documents), f AS (SELECT h, min(doc_id) AS o FROM h GROUP BY 1)
SELECT count(*) AS files_seen, count(*) FILTER (doc_id = o) AS documents_created, count(*) FILTER (doc_id <> o) AS documents_unchanged, CAST(sum(sections) FILTER (doc_id = o) AS BIGINT) AS sections FROM h JOIN f USING (h)""")
def build_counters(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", X.content_hash("text").alias("h"), F.size(F.split("text", "\n")).cast("long").alias("sections"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("o"))
    return identity.build_counters(d.join(first, "h").select((F.col("doc_id") == F.col("o")).alias("created"), "sections"))


@ALL.add(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text FROM documents""")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalized_text("text").alias("text"))


@ALL.add(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS token_count, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS INTEGER) AS words FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.token_count("text").alias("token_count"), F.size(X.tokens("text")).alias("words"))


@ALL.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
s AS (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l), n AS (SELECT *, lower(regexp_replace(line, '\s+', ' ', 'g')) AS norm FROM s WHERE line <> ''),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS n FROM n), k AS (SELECT * FROM c WHERE NOT (n >= 3 AND length(norm) <= 80) AND norm NOT IN ('show menu', 'hide menu')),
a AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_lines FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(a.text, '') AS text, coalesce(n_lines, 0) AS n_lines FROM documents d LEFT JOIN a USING (doc_id)""")
def dedupe_lines(spark: SparkSession, sf: str) -> DataFrame:
    return extract.deduped_lines(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


@ALL.add(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN starts_with(trim(line), '|') AND ends_with(trim(line), '|') THEN 'table' WHEN regexp_matches(line, '^\s*(?:[-*+] |\d+[.)] )') THEN 'list' ELSE 'paragraph' END AS kind FROM l),
o AS (SELECT *, sum(CASE WHEN kind <> 'paragraph' OR coalesce(lag(kind) OVER w <> 'paragraph', true) THEN 1 ELSE 0 END) OVER w AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM k) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT 1""".replace("lag(kind) OVER w <> 'paragraph'", "before <> 'paragraph'").replace("SELECT 1", """, b AS (SELECT doc_id, block, kind, string_agg(line, chr(10) ORDER BY pos) AS content FROM o WHERE kind <> 'blank' GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INTEGER) AS ordinal, kind, content FROM b""").replace(")\n,", "),\n"))
def block_segments(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.block_segments(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


@ALL.add("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(s // 900 AS INTEGER) AS ordinal, trim(substr(text, s + 1, 1000), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM s""")
def char_windows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.char_windows("text", 1000, 100)).alias("ordinal", "text"))


@ALL.add(r"SELECT doc_id, array_to_string(list_filter([trim(source), CASE WHEN trim(lang) <> trim(source) THEN trim(lang) END, trim(text, ' ' || chr(10) || chr(9) || chr(13))], lambda x: x <> '' AND x IS NOT NULL), chr(10)) AS text FROM documents")
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.embedding_text("source", "lang", "text").alias("text"))


@ALL.add("""WITH t AS (SELECT item_id, unnest([text, 'query: ' || text, 'passage: ' || text]) AS t, unnest([0, 1, 2]) AS form FROM benchmark)
SELECT item_id, CAST(form AS INTEGER) AS form, 'query: ' || regexp_replace(t, '^(query|passage): ', '') AS q, 'passage: ' || regexp_replace(t, '^(query|passage): ', '') AS p FROM t""")
def e5_prefix(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.array("text", F.concat(F.lit("query: "), "text"), F.concat(F.lit("passage: "), "text"))).alias("form", "t"))
    return b.select("item_id", "form", X.with_role("t", "query").alias("q"), X.with_role("t", "passage").alias("p"))


@ALL.add(f"""SELECT page_id, {HOST} AS host, '/' || regexp_extract({PATH}, '^/*([^/]*)', 1) AS path_prefix, CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN 1 ELSE 0 END AS has_query, regexp_replace(url, '#.*$', '') AS no_fragment FROM pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.site_host("url").alias("host"), U.path_prefix("url").alias("path_prefix"), U.has_query("url").alias("has_query"), U.without_fragment("url").alias("no_fragment"))


RULES = [U.Rewrite(prefix="/en/", to_path="/english/"), U.Rewrite(prefix="/fr/", to_path="/francais/"), U.Rewrite(prefix="/english/1", to_path="/one/1")]


@ALL.add(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#]*)', 1) AS s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS a, {PATH} AS p, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(.*)$', 1) AS t FROM pages),
r1 AS (SELECT *, CASE WHEN starts_with(p, '/en/') THEN '/english/' || substr(p, 5) ELSE p END AS q FROM p), r2 AS (SELECT *, CASE WHEN starts_with(q, '/fr/') THEN '/francais/' || substr(q, 5) ELSE q END AS q2 FROM r1),
r3 AS (SELECT *, CASE WHEN starts_with(q2, '/english/1') THEN '/one/1' || substr(q2, 11) ELSE q2 END AS q3 FROM r2)
SELECT page_id, CASE WHEN q3 <> p THEN s || lower(a) || q3 || t ELSE url END AS url FROM r3""")
def url_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.canonical_url("url", RULES).alias("url"))


@ALL.add(f"""SELECT page_id, ({HOST} LIKE '%.example.com' OR {HOST} = 'example.com' OR {HOST} LIKE '%.example.org' OR {HOST} = 'example.org') AND NOT ({HOST} LIKE '%.www.example.org' OR {HOST} = 'www.example.org') AND regexp_matches(url, '/(en|fr|de)/') AND NOT regexp_matches(url, 'utm_|[?&]page=') AS admitted FROM pages""")
def url_admission(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.admitted("url", ("example.com", "example.org"), ("www.example.org",), ("/(en|fr|de)/",), ("utm_", "[?&]page=")).alias("admitted"))


@ALL.add(r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", extract.html_title("html").alias("title"))


@ALL.add(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(extract.html_links("html")).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def _strip(sql: str) -> str:
    for tag in ("script", "style", "noscript", "nav", "footer"):
        sql = f"regexp_replace({sql}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    return sql


@ALL.add(f"SELECT page_id, {_strip('html')} AS html FROM pages")
def html_preclean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", extract.precleaned_html("html").alias("html"))


@ALL.add(None)
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Rows-only: sections of every page; the parser is tested on goldens."""
    p = table(spark, sf, "pages").select("page_id", F.posexplode(extract.html_sections("html")).alias("ordinal", "s"))
    return p.select("page_id", "ordinal", "s.heading_path", "s.content", "s.start_char_idx", "s.end_char_idx")


@ALL.add(r"""WITH n AS (SELECT page_id, regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1) AS nav FROM pages),
c AS (SELECT page_id, len(regexp_extract_all(nav, '<a ')) AS n_links, length(array_to_string(regexp_extract_all(nav, '<a [^>]*>([^<]*)</a>', 1), ' ')) AS link_chars, length(trim(regexp_replace(regexp_replace(nav, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_chars FROM n)
SELECT page_id, n_links >= 3 AND text_chars > 0 AND text_chars < 600 AND link_chars / text_chars > 0.7 AS is_menu FROM c""")
def high_link_density(spark: SparkSession, sf: str) -> DataFrame:
    nav = F.regexp_extract("html", r"(?is)<nav>(.*?)</nav>", 1)
    p = table(spark, sf, "pages").select("page_id", nav.alias("nav"))
    words = F.trim(F.regexp_replace(F.regexp_replace("nav", "<[^>]*>", " "), r"\s+", " "))
    links = F.array_join(F.regexp_extract_all("nav", F.lit(r"<a [^>]*>([^<]*)</a>"), 1), " ")
    return p.select("page_id", extract.high_link_density(F.size(F.regexp_extract_all("nav", F.lit("<a "), 0)), F.length(links), F.length(words)).alias("is_menu"))


MD = "'# ' || source || chr(10) || chr(10) || '**' || lang || '** [link](http://x.y/' || doc_id || ')' || chr(10) || '- ' || replace(text, chr(10), chr(10) || chr(10) || '> ')"


@ALL.add(f"""WITH m AS (SELECT doc_id, {MD} AS md FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(md, '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g') AS t FROM m),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^#{{1,6}}\\s+', '', 'g'), '(?m)^[>\\-*+]\\s+', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[*_~`]', '', 'g'), '<[A-Za-z/!][^>]*>', '', 'g') AS t FROM b),
d AS (SELECT doc_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM c)
SELECT doc_id, trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text FROM d""")
def markdown_text(spark: SparkSession, sf: str) -> DataFrame:
    md = F.concat(F.lit("# "), "source", F.lit("\n\n**"), "lang", F.lit("** [link](http://x.y/"), F.col("doc_id").cast("string"), F.lit(")\n- "), F.replace("text", F.lit("\n"), F.lit("\n\n> ")))
    return table(spark, sf, "documents").select("doc_id", extract.markdown_text(md).alias("text"))


@ALL.add("""SELECT doc_id, CAST(0 AS INTEGER) AS ordinal, lang AS heading, trim(text, ' ' || chr(9) || chr(10)) AS content FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''
UNION ALL SELECT doc_id, CAST(CASE WHEN trim(text, ' ' || chr(9) || chr(10)) <> '' THEN 1 ELSE 0 END AS INTEGER), lang || ' > ' || source, source FROM documents""")
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A front part that is dropped, a section, and a nested one, for every document (its Markdown marks taken out)."""
    body = F.regexp_replace("text", r"[*_~`#<>\[\]&]", "")
    md = F.concat(F.lit("---\na: b\n---\nlost\n# "), "lang", F.lit("\n"), "text", F.lit("\n## "), "source", F.lit("\n"), "source")
    rows = table(spark, sf, "documents").withColumn("text", body).select("doc_id", F.posexplode(extract.markdown_sections(extract.without_front_matter(md))).alias("ordinal", "s"))
    return rows.select("doc_id", "ordinal", F.array_join("s.heading_path", " > ").alias("heading"), "s.content")


ALL["markdown_sections"] = type(ALL["markdown_sections"])(ALL["markdown_sections"].run, r"""WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(regexp_replace(regexp_replace(text, '[*_~`#<>\[\]&]', '', 'g'), '(?m)^[\-+]\s+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS t FROM documents)
SELECT doc_id, CAST(0 AS INTEGER) AS ordinal, lang AS heading, t AS content FROM d WHERE t <> ''
UNION ALL SELECT doc_id, CAST(CASE WHEN t <> '' THEN 1 ELSE 0 END AS INTEGER), lang || ' > ' || source, source FROM d""")


@ALL.add("""WITH f AS (SELECT page_id, unnest(['.html', '.HTM', '.md', '.docx', '.tsv', '.webp', '', '.xyz']) AS x, unnest(['', 'text/html; charset=utf-8', 'image/svg+xml', 'text/plain', ' APPLICATION/PDF ', 'text/csv', 'text/markdown', 'a/b']) AS mime FROM pages)
SELECT page_id, x, CASE lower(x) WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'markdown' WHEN '.docx' THEN 'word' WHEN '.tsv' THEN 'spreadsheet' WHEN '.webp' THEN 'image' ELSE CASE mime WHEN 'text/markdown' THEN 'markdown' ELSE 'unknown' END END AS kind,
CASE lower(x) WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'document' WHEN '.docx' THEN 'document' WHEN '.tsv' THEN 'spreadsheet' WHEN '.webp' THEN 'image' ELSE CASE mime WHEN 'text/markdown' THEN 'document' ELSE 'unknown' END END AS family FROM f""")
def file_type_detect(spark: SparkSession, sf: str) -> DataFrame:
    x = F.array(*map(F.lit, [".html", ".HTM", ".md", ".docx", ".tsv", ".webp", "", ".xyz"]))
    m = F.array(*map(F.lit, ["", "text/html; charset=utf-8", "image/svg+xml", "text/plain", " APPLICATION/PDF ", "text/csv", "text/markdown", "a/b"]))
    p = table(spark, sf, "pages").select("page_id", F.explode(F.arrays_zip(x.alias("x"), m.alias("m"))).alias("f"))
    kind = files.content_type(F.concat(F.lit("a/b"), "f.x"), "f.m")
    return p.select("page_id", F.col("f.x").alias("x"), kind.alias("kind"), files.source_family(kind).alias("family"))


@ALL.add(f"SELECT page_id, 'http://mirror.example.net/' || page_id || '?a=1' AS commented, 'https://' || {HOST} || '/x/' AS hosted, 'https://base.example/docs/' || page_id || '.md' AS based FROM pages")
def mirror_urls(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    n = F.col("page_id").cast("string")
    comment = F.concat(F.lit("<!-- Mirrored from http://mirror.example.net/"), n, F.lit("?a=1 by x -->"), "html")
    return p.select(
        "page_id",
        files.mirror_url(F.lit("a/b.html"), comment, "https://base.example").alias("commented"),
        files.mirror_url(F.concat(U.site_host("url"), F.lit("/x/index.html")), F.lit(""), "https://base.example").alias("hosted"),
        files.mirror_url(F.concat(F.lit("docs/"), n, F.lit(".md")), F.lit(""), "https://base.example/").alias("based"),
    )


@ALL.add("""WITH h AS (SELECT doc_id, unnest(['["' || lang || '","' || source || '"]', lang || ' > ' || source, ' ' || source || ' ', '', NULL, '[' || lang]) AS h, unnest(range(6)) AS form FROM documents)
SELECT doc_id, CAST(form AS INTEGER) AS form, CASE form WHEN 0 THEN lang || '/' || source WHEN 1 THEN lang || '/' || source WHEN 2 THEN source WHEN 5 THEN '[' || lang ELSE '' END AS path, CAST(CASE form WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS INTEGER) AS n FROM h JOIN documents USING (doc_id)""")
def heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    forms = F.array(F.concat(F.lit('["'), "lang", F.lit('","'), "source", F.lit('"]')), F.concat_ws(" > ", "lang", "source"), F.concat(F.lit(" "), "source", F.lit(" ")), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("["), "lang"))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(forms).alias("form", "h"))
    p = extract.heading_path("h")
    return d.select("doc_id", "form", F.array_join(p, "/").alias("path"), F.size(p).alias("n"))


@ALL.add("SELECT conv_id, turn, regexp_replace(role, 'x', 'x') || '@' || 'mail.' || 'host' || conv_id || '.org' AS mail FROM conversations")
def email_deobfuscation(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    text = F.concat("role", F.lit(" (at) mail [dot] host"), F.col("conv_id").cast("string"), F.lit(" point org"))
    return c.select("conv_id", "turn", X.deobfuscated_email(text).alias("mail"))


@ALL.add("""SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT DISTINCT FROM 0 AND (d.lang IS NOT DISTINCT FROM 'en' OR d.lang IS NOT DISTINCT FROM 'fr')""")
def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.where(filters.filter_column({"toxic": 0, "lang": ["en", "fr"]})).select("doc_id", "lang", "source", "n_chars")


@ALL.add("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT DISTINCT FROM 0 OR l.quality IS NULL")
def filter_in_null(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.where(filters.filter_column({"quality": [0, None]})).select("doc_id", "quality")


@ALL.add("""WITH c AS (SELECT conv_id, role, max(turn) AS current_turn FROM conversations GROUP BY ALL), x AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1)
SELECT v.conv_id, v.role, v.turn FROM conversations v JOIN c USING (conv_id, role) JOIN x USING (conv_id) WHERE v.turn = c.current_turn AND x.m >= 2""")
def visible_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as revisions of (conversation, role); conversations of fewer than three turns count as deleted."""
    c = table(spark, sf, "conversations").withColumn("document_id", F.concat_ws(":", F.col("conv_id").cast("string"), "role"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m"))
    docs = c.groupBy("document_id", "conv_id").agg(F.max("turn").alias("current_revision_id")).join(last, "conv_id").withColumn("deleted_at", F.when(F.col("m") < 2, F.current_timestamp())).select("document_id", "current_revision_id", "deleted_at", F.lit("c").alias("corpus_id"))
    chunks = c.withColumn("revision_id", F.col("turn"))
    return filters.visible_chunks(chunks, docs, "c").select("conv_id", "role", "turn")


@ALL.add("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def id_lookup_semi(spark: SparkSession, sf: str) -> DataFrame:
    return filters.by_ids(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels").where("toxic = 1"), "doc_id")


@ALL.add("SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def unknown_evidence_anti(spark: SparkSession, sf: str) -> DataFrame:
    return filters.unknown_ids(table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")), table(spark, sf, "labels"), "doc_id")


@ALL.add("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'none' ELSE CAST(l.quality AS VARCHAR) END AS quality, coalesce(d.lang, 'x') AS lang, CAST(2 + CASE WHEN l.quality IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n FROM documents d LEFT JOIN labels l USING (doc_id)""")
def metadata_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    meta = F.create_map(F.lit("lang"), F.lit("old"), F.lit("kept"), F.lit("yes"))
    m = filters.merged_metadata(meta, {"lang": F.col("lang"), "quality": F.col("quality")})
    return d.select("doc_id", F.coalesce(m["quality"], F.lit("none")).alias("quality"), m["lang"].alias("lang"), F.size(m).alias("n"))


@ALL.add(f"SELECT page_id, 'html' AS family, {HOST} AS host, '/' || regexp_extract({PATH}, '^/*([^/]*)', 1) AS prefix, CAST(4 AS INTEGER) AS n FROM pages")
def chunk_provenance(spark: SparkSession, sf: str) -> DataFrame:
    m = filters.provenance_metadata(F.lit("html"), "url", extra={"section_id": F.lit(None)})
    return table(spark, sf, "pages").select("page_id", m["source_family"].alias("family"), m["site_host"].alias("host"), m["path_prefix"].alias("prefix"), F.size(m).alias("n"))


@ALL.add("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 500 AND source IS NOT NULL")
def document_admission(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("content_type", F.when(F.col("source").isNotNull(), "html"))
    return extract.admitted_documents(d, True, 500).select("doc_id", "n_chars")


@ALL.add(None)
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows-only: packed chunks of every document; the packer is tested on goldens and properties."""
    d = table(spark, sf, "documents").select(X.stable_id("revision", "doc_id").alias("revision_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.lit("").alias("url"), "text")
    return chunking.chunk_rows(d, "structural").drop("heading_path")
