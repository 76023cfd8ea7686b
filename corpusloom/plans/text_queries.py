"""Queries over documents and pages: parsing, cleaning, filtering, chunking, counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as C
from corpusloom.functions import labels
from corpusloom.functions import text as X
from corpusloom.operators import chunking, cleaning, filtering, parsing, ranking, reports
from corpusloom.plans.catalog import d_clean_markdown, d_list, d_normalize, d_quote, d_strip, query
from corpusloom.sources.readers import explode_keyed_json
from corpusloom.tables import spread

# ---------------------------------------------------------------- sources and reports

KEYED = """chr(123) || '"' || event_type || '": ' || chr(123) || '"n": ' || CAST(event_id AS STRING)
 || ', "kind": "' || event_type || '"' || chr(125) || ', "extra": ' || CAST(user_id AS STRING) || chr(125)"""


@query("S03_keyed_json", f"""
SELECT event_id, name, CAST(json_extract_string(j, '$."' || name || '".n') AS BIGINT) AS n,
  json_extract_string(j, '$."' || name || '".kind') AS kind
FROM (SELECT event_id, j, unnest(json_keys(j)) AS name FROM (SELECT event_id, CAST({KEYED} AS JSON) AS j FROM events))""")
def s03(t):
    keyed = t.events.select("event_id", F.expr(KEYED).alias("doc"))
    return explode_keyed_json(keyed, "doc", "n bigint, kind string", keep=["event_id"])


@query("S04_quota_sample", """
SELECT doc_id, lang, matched FROM (
  SELECT doc_id, lang, lang <> 'en' AS matched,
    row_number() OVER (PARTITION BY lang <> 'en' ORDER BY doc_id) AS r FROM documents)
WHERE (matched AND r <= 120) OR (NOT matched AND r <= 80)""")
def s04(t):
    return reports.quota_sample(t.documents.select("doc_id", "lang"), F.col("lang") != "en")


@query("S05_dataset_manifest", """
SELECT (SELECT count(*) FROM wiki) AS records, (SELECT CAST(sum(strlen(markdown)) AS BIGINT) FROM wiki) AS bytes,
  (SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT unnest(category) AS c FROM
     (SELECT category FROM wiki ORDER BY doc_id LIMIT 100))) AS categories""", ["wiki"])
def s05(t):
    return reports.dataset_manifest(t.wiki, "markdown", "category", "doc_id")


@query("S17_stage_report", """
SELECT lang, docs, chars, longest,
  chr(123) || '"docs":' || docs || ',"chars":' || chars || ',"longest":' || longest || chr(125) AS report
FROM (SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(max(length(text)) AS INT) AS longest FROM documents GROUP BY lang)""")
def s17(t):
    metrics = {"docs": F.count(F.lit(1)), "chars": F.sum(F.length("text")), "longest": F.max(F.length("text"))}
    return reports.stage_report(t.documents, metrics, ["lang"])


# ---------------------------------------------------------------- parsing

_SLUG = "replace(url_decode(replace(string_split(url, '/wiki/')[-1], '+', '%2B')), '', '')"

_TITLE_SQL = f"""coalesce(
  CASE WHEN sections[1].title <> '' THEN trim({d_strip('sections[1].title')}, '"') END,
  CASE WHEN contains(url, '/wiki/') THEN replace({_SLUG}, '_', ' ') END, 'Unknown')"""


@query("P01_title", f"SELECT doc_id, {_TITLE_SQL} AS title FROM wiki", ["wiki"])
def p01(t):
    return parsing.with_title(t.wiki.drop("title")).select("doc_id", "title")


@query("P02_doc_id", f"""
SELECT doc_id, 'wiki_' || CASE WHEN contains(url, '/wiki/') THEN replace(replace({_SLUG}, ' ', '_'), '/', '_')
  ELSE left(md5(url), 12) END AS page_key FROM wiki""", ["wiki"])
def p02(t):
    return parsing.with_doc_id(t.wiki).select("doc_id", "page_key")


@query("P02_doc_id_of_pages", "SELECT page_id, 'wiki_' || left(md5(url), 12) AS page_key FROM pages")
def p02_pages(t):
    return parsing.with_doc_id(t.pages.select("page_id", "url")).select("page_id", "page_key")


def _type_sql() -> str:
    branches = []
    for name, members, parts in C.ENTITY_TYPE_RULES:
        tests = [f"list_contains(category, {d_quote(m)})" for m in members]
        tests += [f"len(list_filter(category, lambda x: contains(x, {d_quote(p)}))) > 0" for p in parts]
        branches.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(branches) + " ELSE 'Other' END"


@query("P03_entity_type", f"SELECT doc_id, {_type_sql()} AS entity_type FROM wiki", ["wiki"])
def p03(t):
    return parsing.with_entity_type(t.wiki).select("doc_id", "entity_type")


_REGIONS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(array_to_string(category, ' ')), {d_quote(k.lower())}) THEN {d_quote(n)} END"
    for k, n in C.REGION_KEYWORDS) + "], lambda x: x IS NOT NULL)"


@query("P04_regions", f"SELECT doc_id, array_to_string({_REGIONS_SQL}, '|') AS regions FROM wiki", ["wiki"])
def p04(t):
    return parsing.with_regions(t.wiki).select("doc_id", F.array_join("regions", "|").alias("regions"))


@query("P05_clean_markdown", f"SELECT doc_id, length(c) AS size, md5(c) AS digest FROM (SELECT doc_id, {d_clean_markdown('markdown')} AS c FROM wiki)", ["wiki"])
def p05(t):
    text = X.clean_markdown(F.col("markdown"))
    return t.wide.wiki.select("doc_id", "markdown").select("doc_id", text.alias("c")).select(
        "doc_id", F.length("c").cast("long").alias("size"), F.md5(F.col("c").cast("binary")).alias("digest"))


_SECTIONS_SQL = f"""
SELECT doc_id, i AS place, title, level, content FROM (
  SELECT doc_id, i, {d_strip("coalesce(s.title, '')")} AS title, s.level AS level,
    CASE WHEN starts_with(body, '#') THEN {d_strip("regexp_replace(body, '^[^\\n]*\\n?', '')")} ELSE body END AS content
  FROM (SELECT doc_id, i, s, {d_clean_markdown(d_strip("coalesce(s.markdown, '')"))} AS body FROM (
    SELECT doc_id, unnest(sections) AS s, generate_subscripts(sections, 1) AS i FROM wiki)))
WHERE content <> ''"""


@query("P06_parse_sections", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INT) AS section_no, title, level,
  length(content) AS size, md5(content) AS digest FROM ({_SECTIONS_SQL})""", ["wiki"])
def p06(t):
    rows = t.wide.wiki.select("doc_id", "sections").select(
        "doc_id", F.posexplode(X.parse_sections(F.col("sections"))).alias("section_no", "s"))
    return rows.select("doc_id", "section_no", "s.title", "s.level", F.length("s.content").cast("long").alias("size"),
                       F.md5(F.col("s.content").cast("binary")).alias("digest"))


_NO_CODE = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
  '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""


def _untag(x: str) -> str:
    x = rf"regexp_replace({_NO_CODE.format(x)}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return d_strip(rf"regexp_replace({x}, '[ \t\r\n]+', ' ', 'g')")


@query("P07_html_sections", rf"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS section_no, title, level,
  length(content) AS size, md5(content) AS digest
FROM (SELECT page_id, i,
    CASE WHEN headed THEN {_untag("regexp_extract(p, '(?is)^h[1-6][^>]*>(.*?)</h[1-6]', 1)")} ELSE '' END AS title,
    CASE WHEN headed THEN CAST(substr(p, 2, 1) AS INT) ELSE 0 END AS level,
    {_untag("CASE WHEN headed THEN regexp_replace(p, '(?is)^h[1-6][^>]*>.*?</h[1-6]\\s*>', ' ') ELSE p END")} AS content
  FROM (SELECT page_id, i, p, regexp_matches(p, '(?i)^h[1-6][^a-z0-9]') AS headed FROM (
    SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT page_id, string_split(regexp_replace({_NO_CODE.format('html')}, '(?i)<(h[1-6][^a-z0-9])', chr(1) || '\1', 'g'), chr(1)) AS ps
      FROM pages))))
WHERE content <> '' OR title <> ''""")
def p07(t):
    rows = spread(t.pages.select("page_id", "html")).select("page_id", F.posexplode(X.html_sections(F.col("html"))).alias("section_no", "s"))
    return rows.select("page_id", "section_no", "s.title", "s.level", F.length("s.content").cast("long").alias("size"),
                       F.md5(F.col("s.content").cast("binary")).alias("digest"))


@query("P08_content_hash", "SELECT doc_id, length(text) AS content_length, sha256(text) AS content_hash FROM documents")
def p08(t):
    return parsing.with_hash(t.documents.select("doc_id", "text"), "text").select(
        "doc_id", F.col("content_length").cast("long"), "content_hash")


@query("P09_normalize_text", f"SELECT doc_id, length(c) AS size, md5(c) AS digest FROM (SELECT doc_id, {d_normalize('markdown')} AS c FROM wiki)", ["wiki"])
def p09(t):
    return t.wide.wiki.select("doc_id", "markdown").select("doc_id", X.normalize_text(F.col("markdown")).alias("c")).select(
        "doc_id", F.length("c").cast("long").alias("size"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query("P10_clean_sections", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INT) AS section_no, title,
  length(c) AS size, md5(c) AS digest
FROM (SELECT doc_id, place, title, {d_normalize('content')} AS c FROM ({_SECTIONS_SQL})
  WHERE title NOT IN {d_list(C.SKIPPED_SECTIONS)}) WHERE c <> ''""", ["wiki"])
def p10(t):
    cleaned = X.clean_sections(X.parse_sections(F.col("sections")))
    rows = t.wide.wiki.select("doc_id", "sections").select("doc_id", F.posexplode(cleaned).alias("section_no", "s"))
    return rows.select("doc_id", "section_no", "s.title", F.length("s.content").cast("long").alias("size"),
                       F.md5(F.col("s.content").cast("binary")).alias("digest"))


_ALIAS_CASE = "CASE title " + " ".join(f"WHEN {d_quote(a)} THEN {d_quote(c)}" for a, c in C.TITLE_ALIASES.items()) + " END"


@query("P11_canonical_name", f"""
SELECT doc_id, title, coalesce({_ALIAS_CASE}, title) AS canonical_name,
  CASE WHEN {_ALIAS_CASE} IS NULL THEN '' ELSE title END AS aliases
FROM (SELECT doc_id, {_TITLE_SQL} AS title FROM wiki)""", ["wiki"])
def p11(t):
    return cleaning.with_canonical(parsing.with_title(t.wiki.drop("title"))).select(
        "doc_id", "title", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


@query("P13_ascii_id", r"""
SELECT doc_id, md5(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS digest FROM documents""")
def p13(t):
    return spread(t.documents.select("doc_id", "text")).select(
        "doc_id", F.md5(X.ascii_id(F.col("text")).cast("binary")).alias("digest"))


@query("P14_first_sentence", "SELECT doc_id, CASE WHEN contains(text, '.') THEN string_split(text, '.')[1] ELSE left(text, 200) END AS sentence FROM documents")
def p14(t):
    return t.documents.select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query("P15_clipped_document", f"""
SELECT doc_id, length(clipped) AS size, md5(clipped) AS digest,
  md5('### [' || entity_type || '] ' || canonical_name || chr(10) || left(content, {C.ORACLE_PROMPT_CHARS})) AS oracle_digest
FROM (SELECT *, CASE WHEN length(content) > {C.EXTRACT_PROMPT_CHARS}
  THEN left(content, {C.EXTRACT_PROMPT_CHARS}) || chr(10) || chr(10) || '[... truncated ...]' ELSE content END AS clipped FROM clean_wiki)""", ["clean_wiki"])
def p15(t):
    rows = cleaning.clip_document(t.clean_wiki)
    return rows.select("doc_id", F.length("clipped").cast("long").alias("size"), F.md5(F.col("clipped").cast("binary")).alias("digest"),
                       F.md5(cleaning.oracle_document(rows).cast("binary")).alias("oracle_digest"))


@query("P16_script_language", r"""
SELECT question_id, CASE WHEN regexp_matches(question, '[一-鿿぀-ヿ]') THEN 'zh' ELSE 'en' END AS lang FROM questions""", ["questions"])
def p16(t):
    return t.questions.select("question_id", X.script_lang(F.col("question")).alias("lang"))


@query("P17_source_preview", "SELECT doc_id, canonical_name, entity_type, left(content, 500) AS preview, regions[1] AS region FROM clean_wiki", ["clean_wiki"])
def p17(t):
    rows = t.clean_wiki.withColumn("full_text", F.col("content"))
    return cleaning.source_preview(rows).select("doc_id", "canonical_name", "entity_type", "preview", "region")


@query("P20_date_label", """
SELECT event_id,
  CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' ELSE strftime(ts, '%b %-d') END AS label,
  CASE WHEN n = 0 THEN strftime(ts, '%I:%M %p') WHEN n < 7 THEN CAST(n AS STRING) || 'd ago' ELSE strftime(ts, '%b %-d') END AS age
FROM (SELECT event_id, ts, date_diff('day', CAST(ts AS DATE), DATE '2024-01-12') AS d,
  CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-12 15:00:00') / 86400000000.0) AS BIGINT) AS n FROM events)""")
def p20(t):
    now = F.lit("2024-01-12 15:00:00").cast("timestamp_ntz")
    return t.events.select("event_id", labels.date_bucket(F.col("ts"), now).alias("label"), labels.relative_age(F.col("ts"), now).alias("age"))


# ---------------------------------------------------------------- filters

_TOPIC_RE = "(?i)" + "|".join(C.TOPIC_KEYWORDS)
_RAW_RE = "(?i)" + "|".join(C.RAW_TOPIC_KEYWORDS)


def _parsed(t):
    return parsing.parse_pages(t.wide.wiki.drop("title"))


@query("F01_topic_filter", f"""
SELECT doc_id FROM (SELECT doc_id, {_TITLE_SQL} AS title, {_REGIONS_SQL} AS regions, array_to_string(category, ' ') AS cats,
  {d_clean_markdown('markdown')} AS content FROM wiki)
WHERE list_contains(regions, 'Sumeru') OR regexp_matches(cats, '{_TOPIC_RE}') OR regexp_matches(title, '{_TOPIC_RE}')
  OR regexp_matches(content, '{_TOPIC_RE}')""", ["wiki"])
def f01(t):
    return filtering.topic_filter(_parsed(t)).select("doc_id")


@query("F02_raw_topic_filter", f"""
SELECT doc_id FROM wiki WHERE len(list_filter(category, lambda c: regexp_matches(c, '(?i)sumeru|dendro|akademiya'))) > 0
  OR regexp_matches(url, '{_RAW_RE}') OR regexp_matches(markdown, '{_RAW_RE}')""", ["wiki"])
def f02(t):
    return filtering.topic_filter_raw(t.wide.wiki).select("doc_id")


@query("F03_min_length", f"SELECT doc_id, length(c) AS size FROM (SELECT doc_id, {d_normalize('text')} AS c FROM documents) WHERE length(c) >= 50")
def f03(t):
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", X.normalize_text(F.col("text")).alias("content"))
    return cleaning.min_length(rows).select("doc_id", F.length("content").cast("long").alias("size"))


def d_valid_alias(x: str) -> str:
    alias = f"trim({d_strip(x)}, chr(34) || chr(39))"
    return f"""CASE WHEN length({alias}) BETWEEN 2 AND 50 AND lower({alias}) NOT IN {d_list(sorted(set(C.ALIAS_STOPWORDS)))}
      AND length(regexp_replace({alias}, '[^\\p{{L}}\\s]', '', 'g')) / length({alias}) >= 0.7 THEN {alias} END"""


@query("F04_valid_alias", f"""
SELECT entity_key, word, {d_valid_alias('word')} AS alias
FROM (SELECT entity_key, unnest(string_split(description, ' ')) AS word FROM alias_texts)""", ["alias_texts"])
def f04(t):
    words = t.alias_texts.select("entity_key", F.explode(F.split("description", " ")).alias("word"))
    return words.select("entity_key", "word", X.valid_alias(F.col("word")).alias("alias"))


# ---------------------------------------------------------------- counts and deduplication

@query("A01_count_by_type", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def a01(t):
    return reports.count_by(t.documents, "lang")


@query("A02_count_by_region", f"SELECT value, count(*) AS n FROM (SELECT unnest({_REGIONS_SQL}) AS value FROM wiki) GROUP BY value", ["wiki"])
def a02(t):
    return reports.count_by_array(parsing.with_regions(t.wiki), "regions")


@query("A03_filter_yield", f"""
SELECT count(*) FILTER (keep) AS kept, count(*) AS total, round(count(*) FILTER (keep) * 100.0 / count(*), 1)::DOUBLE AS percent
FROM (SELECT list_contains({_REGIONS_SQL}, 'Sumeru') AS keep FROM wiki)""", ["wiki"])
def a03(t):
    return reports.filter_yield(parsing.with_regions(t.wiki), F.array_contains("regions", C.TOPIC_REGION))


@query("A04_exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY sha256(text)")
def a04(t):
    rows = parsing.with_hash(t.documents.select("doc_id", "text"), "text").select("doc_id", "content_hash")
    return ranking.dedup_exact(rows)


@query("A05_clean_counters", f"""
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS duplicates,
  count(*) FILTER (size < 50) AS too_short, count(*) FILTER (size >= 50) AS kept
FROM (SELECT count(*) AS n, min(length({d_normalize('text')})) AS size FROM documents GROUP BY sha256(text))""")
def a05(t):
    rows = parsing.with_hash(spread(t.documents.select("doc_id", F.col("text").alias("content"))))
    return cleaning.clean_counters(rows)


_CLEAN_SQL = f"""
SELECT doc_id, lang, source, content FROM (
  SELECT doc_id, lang, source, {d_normalize('text')} AS content,
    row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
WHERE r = 1 AND length(content) >= 50"""


@query("flagship_usable_documents", f"SELECT lang, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM ({_CLEAN_SQL}) GROUP BY lang")
def usable_documents(t):
    """Distinct usable documents per language: hash, keep first, normalise, drop short, count."""
    hashed = parsing.with_hash(spread(t.documents.select("doc_id", "lang", F.col("text").alias("content"))))
    # The digest is cheap to shuffle; texts are normalised only for the rows that stay.
    unique = ranking.dedup_exact(hashed)
    cleaned = unique.withColumn("content", X.normalize_text(F.col("content")))
    return cleaning.min_length(cleaned).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("corpus_build", f"""
SELECT doc_id, entity_type, canonical_name, length(c) AS content_length FROM (
  SELECT doc_id, {_type_sql()} AS entity_type, {d_normalize(d_clean_markdown('markdown'))} AS c,
    coalesce({_ALIAS_CASE}, title) AS canonical_name,
    row_number() OVER (PARTITION BY sha256({d_clean_markdown('markdown')}) ORDER BY doc_id) AS r
  FROM (SELECT doc_id, category, markdown, {_TITLE_SQL} AS title FROM wiki))
WHERE r = 1 AND length(c) >= 50""", ["wiki"])
def corpus_build(t):
    return cleaning.clean_documents(_parsed(t)).select(
        "doc_id", "entity_type", "canonical_name", F.col("content_length").cast("long").alias("content_length"))


_WINDOWS_SQL = """
SELECT doc_id, CAST(i AS INT) AS window_index, substr(text, CAST(i * 1848 + 1 AS BIGINT), 2048) AS text, lang
FROM (SELECT doc_id, lang, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 200) / 1848.0) AS BIGINT) - 1))) AS i FROM documents)"""


@query("D03_fixed_windows", f"SELECT doc_id, window_index, length(text) AS size, md5(text) AS digest FROM ({_WINDOWS_SQL})")
def d03(t):
    rows = chunking.fixed_windows(spread(t.documents.select("doc_id", "text")), "text")
    return rows.select("doc_id", "window_index", F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("A06_chunk_stats", f"""
SELECT lang AS entity_type, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(chars) AS BIGINT) AS total_length,
  round(sum(n) / count(*), 1) AS chunks_per_document, round(sum(chars) / sum(n), 1) AS avg_length
FROM (SELECT lang, doc_id, count(*) AS n, sum(length(text)) AS chars FROM ({_WINDOWS_SQL}) GROUP BY lang, doc_id)
GROUP BY ROLLUP (lang)""")
def a06(t):
    chunks = chunking.fixed_windows(spread(t.documents.select("doc_id", F.col("lang").alias("entity_type"), "text")), "text")
    return reports.chunk_stats(chunks.withColumn("text_length", F.length("text")))


@query("A07_text_stats", """
SELECT count(*) AS rows, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS avg_length,
  CAST(max(length(text)) AS INT) AS max_length, CAST(min(length(text)) AS INT) AS min_length FROM documents""")
def a07(t):
    return reports.text_stats(t.documents, "text")


@query("X08_token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def x08(t):
    return t.documents.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------- chunks

@query("D01_split_text")
def d01(t):
    chunks = chunking.split_text(spread(t.documents.select("doc_id", "text")), "text")
    return chunks.select("doc_id", "chunk_index", F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("D02_chunk_documents")
def d02(t):
    docs = cleaning.clean_documents(_parsed(t))
    return chunking.chunk_documents(docs).select("chunk_id", "doc_id", "title", "section_title", "chunk_index", "text_length", "content_hash")


# ---------------------------------------------------------------- selection

@query("W01_select_documents", f"""
SELECT doc_id, entity_type, length(content) AS size FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY length(content) DESC, doc_id) AS r FROM clean_wiki)
WHERE entity_type IN {d_list(C.EXTRACT_ALL_TYPES)}
  OR entity_type NOT IN {d_list([*C.EXTRACT_TYPE_CAPS, *C.EXTRACT_SKIPPED_TYPES])}
  OR r <= CASE entity_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in C.EXTRACT_TYPE_CAPS.items())} END""", ["clean_wiki"])
def w01(t):
    sized = t.clean_wiki.select("doc_id", "entity_type", F.length("content").cast("long").alias("size"))
    return ranking.select_documents(sized, size=F.col("size"))


@query("W02_budget_stop", """
SELECT doc_id, cost, before AS spent_before FROM (
  SELECT doc_id, cost, coalesce(CAST(sum(cost) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM (SELECT doc_id, (length(text) // 4) * 3 + 1500 AS cost FROM documents))
WHERE before < 1400000 * 0.95""")
def w02(t):
    costs = t.documents.select("doc_id", (X.estimate_tokens(F.col("text")) * 3 + 1500).alias("cost"))
    return ranking.within_budget(costs, "cost", "doc_id", 1_400_000)
