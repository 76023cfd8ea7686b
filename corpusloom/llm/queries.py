"""The registered queries of these operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import table
from corpusloom.tables import let_workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the tables of a folder, with the statement that must agree with it."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            let_workers_import(spark)
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def vocabulary() -> str:
    """Path of the tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_substring_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.substrings import without_repeats

    return without_repeats(table(spark, folder, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


@query("op9_bpe")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.bpe import encoded

    return encoded(table(spark, folder, "documents"), vocabulary(), digests=True)


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.quality import scored

    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def listed(spans: str):
    """``kind:start:end`` items of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def count_of(spans: str, kind):
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.pii import KINDS, find_pii

    found = find_pii(table(spark, folder, "documents"))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM per_source),
level(n, x) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT n + 1, (SELECT (1.5::DOUBLE * sum(source_size) - 2.0::DOUBLE * sum(CASE WHEN w * x > 2.0::DOUBLE * source_size THEN source_size ELSE 0 END))
                        / sum(CASE WHEN NOT w * x > 2.0::DOUBLE * source_size THEN w END) FROM weighed)
  FROM level WHERE n < 60),
goal AS (
  SELECT source AS s, source_size, least(w * (SELECT x FROM level WHERE n = 60), 2.0::DOUBLE * source_size) AS target,
         ('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 5))::INT / 1048576.0::DOUBLE AS u FROM weighed),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1)::DOUBLE AS i FROM sized JOIN goal ON source IS NOT DISTINCT FROM s),
each AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e FROM placed)
SELECT doc_id, size, source_size, target, ((floor((i + 1) * e + u) - floor(i * e + u)) * size)::BIGINT AS taken FROM each
"""


@query("op2_mixing", MIX_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def sketch_sql(text: str) -> str:
    return rf"""(SELECT coalesce(list(DISTINCT h ORDER BY h), []) FROM (
        SELECT substr(md5(array_to_string(list_slice(w, i, i + 4), ' ')), 1, 16) AS h
        FROM (SELECT regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w), unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0)
        WHERE h < '2000000000000000')"""


FINGERPRINT_SQL = f"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
two AS (
  SELECT a.doc_id, a.text, a.n, b.text AS after, left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) AS edited
  FROM (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM own) a JOIN own b ON b.doc_id = a.next_id),
made AS (
  SELECT *, {sketch_sql('text')} AS s, {sketch_sql('edited')} AS e, {sketch_sql('after')} AS f FROM two)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  substr(md5(text), 1, 16) || ':' || array_to_string(s, ',') AS fingerprint, substr(md5(edited), 1, 16) || ':' || array_to_string(e, ',') AS edited_fingerprint,
  CASE WHEN text = edited THEN 1.0 WHEN len(s) + len(e) = 0 THEN 0.0 ELSE len(list_intersect(s, e)) / len(list_distinct(s || e)) END::DOUBLE AS near_edited,
  CASE WHEN text = after THEN 1.0 WHEN len(s) + len(f) = 0 THEN 0.0 ELSE len(list_intersect(s, f)) / len(list_distinct(s || f)) END::DOUBLE AS near_next,
  CASE WHEN len(s) > 0 THEN len(list_intersect(s, e)) / len(s) END::DOUBLE AS in_edited
FROM made
"""


@query("op1_fingerprints", FINGERPRINT_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, folder, "documents"))


def secrets_sql() -> str:
    from corpusloom.llm.secrets import BASE, RULES

    def found(number: int) -> str:
        rule = RULES[number]
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        return f"""SELECT doc_id, {number} AS kind, '{rule.kind}' AS name, start, start + size AS stop FROM (
            SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS start,
                   length(m[i]) AS size, length(t[i]) AS tested
            FROM (SELECT doc_id, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}, 0) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS t
                  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE regexp_matches(text, {pattern}))) WHERE tested >= {rule.least}"""

    every = " UNION ALL ".join(found(k) for k in range(len(RULES)))
    item = "name || ':' || start::BIGINT || ':' || stop::BIGINT"
    counts = ", ".join(f"count(s.kind) FILTER (s.kind = {k})::BIGINT AS n_{name}" for k, name in enumerate(BASE))
    return f"""SELECT d.doc_id, {counts},
        sha256(coalesce(string_agg({item}, ',' ORDER BY start, s.kind) FILTER (s.kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({item}, ',' ORDER BY start, s.kind), '') AS spans
        FROM documents d LEFT JOIN ({every}) s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


@query("op5_secrets", secrets_sql())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.secrets import BASE, RULES, find_secrets

    found = find_secrets(table(spark, folder, "documents"))
    names = F.array(*[F.lit(r.kind) for r in RULES])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")
    counts = [count_of("spans", k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    base = F.filter("spans", lambda s: s.kind < len(BASE))
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


@query("op4_embedding_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.embeddings import near_embeddings

    return near_embeddings(table(spark, folder, "embeddings"))


@query("op3_token_rollup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts of all documents come in, are revised to tokens of a vocabulary, and later copies of a text go; one
    batch is committed again after it was folded into the maintained totals."""
    import uuid

    from corpusloom.llm.rollups import TokenRollup, deleted, inserted, revised, token_counts
    from corpusloom.llm.shared import stored
    from corpusloom.session import shared_folder

    docs = table(spark, folder, "documents")
    words, tokens = stored(token_counts(docs)), stored(token_counts(docs, vocabulary(), "word_bpe_49k"))
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("1-insert", inserted(words))
    rollup.commit("2-revise", revised(words, tokens))
    rollup.fold()
    rollup.commit("2-revise", revised(words, tokens))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    firsts = docs.groupBy(digest.alias("digest")).agg(F.min("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    later = tokens.filter("doc_id is not null").join(firsts, "doc_id", "left_anti")  # joined by id, so copies don't meet in one task
    rollup.commit("3-delete", deleted(later))
    return rollup.totals()


@query("op11_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.runs import find_runs

    return find_runs(table(spark, folder, "documents"), periodic=True, digests=True)


def manifest_sql(levels: int = 8, top_levels: int = 4) -> str:
    """Trees of up to 8 ** levels documents per language and 8 ** top_levels languages."""

    def framed(value: str) -> str:
        return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"

    def climb(name: str, rounds: int) -> str:
        steps = []
        for k in range(rounds):
            steps.append(f"""{name}{k + 1} AS MATERIALIZED (
              SELECT tree, place // 8 AS place, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE any_value(h) END AS h, (any_value(n) + 7) // 8 AS n
              FROM {name}{k} GROUP BY tree, place // 8),
            {name}_steps{k} AS MATERIALIZED (
              SELECT tree, place, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER before, '') END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER behind, '') END AS r FROM {name}{k}
              WINDOW before AS (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     behind AS (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""")
        return ", ".join(steps)

    def fold(name: str, rounds: int, tree: str, place: str, start: str) -> str:
        """CTEs that carry every row up one level at a time: its digest so far and its proof so far."""
        steps = []
        for k in range(rounds):
            steps.append(f"""{name}_fold{k + 1} AS MATERIALIZED (
              SELECT f.* EXCLUDE (f, proof), CASE WHEN s.l IS NOT NULL THEN sha256(s.l || f.f || s.r) ELSE f.f END AS f, f.proof || coalesce(s.l || s.r, '') AS proof
              FROM {start if k == 0 else f'{name}_fold{k}'} f JOIN {name}_steps{k} s ON s.tree = f.{tree} AND s.place = f.{place} // {8**k})""")
        return ", ".join(steps)

    leaf = " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH crc_table AS (
      SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
    summed AS (
      SELECT d.*, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
      FROM documents d, crc_table),
    leaves AS (
      SELECT doc_id, lang, sha256({leaf} || {framed('text')}) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256({leaf} || {framed(lower)}) END AS changed FROM summed),
    placed AS MATERIALIZED (
      SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
    node0 AS (SELECT tree, place, leaf AS h, n FROM placed),
    {climb('node', levels)},
    top0 AS (SELECT 0 AS tree, tree AS place, h, count(*) OVER () AS n FROM node{levels}),
    {climb('top', top_levels)},
    start AS (SELECT doc_id, leaf, tree, place, 0 AS zero, coalesce(changed, leaf) AS f, '' AS proof FROM placed),
    {fold('node', levels, 'tree', 'place', 'start')},
    {fold('top', top_levels, 'zero', 'tree', f'node_fold{levels}')}
    SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = r.h AS verified
    FROM top_fold{top_levels} w JOIN node{levels} s ON s.tree = w.tree CROSS JOIN top{top_levels} r"""


@query("op12_manifest", manifest_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.manifest import verified_documents

    return verified_documents(table(spark, folder, "documents"))


def piece_model() -> str:
    """Path of the SentencePiece model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_pieces")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from corpusloom.llm.pieces import encoded

    return encoded(table(spark, folder, "documents"), piece_model(), digests=True)
