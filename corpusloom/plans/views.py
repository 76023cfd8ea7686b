"""Views derived from the given tables, one SQL text for both engines.

The raw tables leave many branches of the operators unvisited (no wiki URLs, no markup, a
tree-shaped graph, vectors that are never close), so each view decorates whole tables by
formula. Spark reads a view as a DataFrame; an oracle statement carries it as a CTE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from corpusloom import constants as C


class SparkDialect:
    def __init__(self, sql_name: Callable[[str], str]):
        self.sql_name = sql_name

    def table(self, name: str) -> str:
        return f"({VIEWS[name](self)})" if name in VIEWS else self.sql_name(name)

    def arr(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if xs else "CAST(array() AS ARRAY<STRING>)"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def cat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def idiv(self, a: str, b: str) -> str:
        return f"CAST(({a}) div ({b}) AS INT)"

    def each(self, xs: str, body: str) -> str:
        """Body uses x and the 0-based index i."""
        return f"transform({xs}, (x, i) -> {body})"

    def only(self, xs: str, body: str) -> str:
        return f"filter({xs}, x -> {body})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_join(transform({xs}, x -> CAST(x AS STRING)), '{sep}')"

    def seq(self, low: str, high: str) -> str:
        return f"sequence({low}, {high})"

    def ts(self, seconds: str) -> str:
        return f"CAST(timestamp_seconds({seconds}) AS TIMESTAMP_NTZ)"


class DuckDialect(SparkDialect):
    def __init__(self):
        super().__init__(str)

    def arr(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]" if xs else "CAST([] AS VARCHAR[])"

    def struct(self, **fields: str) -> str:
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def cat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def idiv(self, a: str, b: str) -> str:
        return f"CAST(({a}) // ({b}) AS INT)"

    def each(self, xs: str, body: str) -> str:
        return f"list_transform({xs}, lambda x, j: {body.replace('{i}', '(j - 1)')})"

    def only(self, xs: str, body: str) -> str:
        return f"list_filter({xs}, lambda x: {body})"

    def join(self, xs: str, sep: str) -> str:
        return f"array_to_string({xs}, '{sep}')"

    def seq(self, low: str, high: str) -> str:
        return f"generate_series({low}, {high})"

    def ts(self, seconds: str) -> str:
        return f"make_timestamp(({seconds}) * 1000000)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if "'" not in text else " || chr(39) || ".join(
        f"'{part}'" for part in text.split("'"))


def pick(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


NL = "chr(10)"

# One category list per entity type rule, then one without a rule and an empty one.
CATEGORY_LISTS = [
    ["Playable Characters", "Characters"], ["Past Archons"], ["Open NPCs"], ["Characters"],
    ["Enemies"], ["North Locations"], ["Quests"], ["Achievements"], ["Soundtracks"],
    ["Furnishings"], ["Weapon Series"], ["Artifact Sets"], ["Dish List"], ["Material Drops"],
    ["Talents"], ["Constellations"], ["TCG Cards"], ["Readable Texts"], ["Terminology"],
    ["Dialogue"], ["Event Items"], ["Misc"], [],
]


def wiki(d: SparkDialect) -> str:
    key = "CAST(doc_id AS STRING)"
    aliases = [lit(a) for a in C.TITLE_ALIASES]
    regions = [d.arr(f"'region ' || {lit(k.lower())}") for k, _ in C.REGION_KEYWORDS]
    regions.append(d.arr("'Paths of The'", "'Chasm Gate'"))
    third = d.idiv("length(text)", "3")
    heading = f"'# ' || coalesce(title, '') || {NL}"
    section = lambda t, l, m: d.struct(title=t, level=l, markdown=m)
    return f"""
SELECT doc_id, text, lang, source, url,
  {d.cat(d.cat('kind_list', 'region_list'), 'extra_list')} AS category, title,
  {heading} || {NL} || CASE WHEN doc_id % 17 = 5 THEN 'Akasha ' ELSE '' END
    || CASE WHEN doc_id % 3 = 0 THEN replace(text, {NL}, {NL} || {NL} || {NL}) ELSE text END
    || {NL} || '![alt](u/x.png)' || {NL} || '---' || {NL} || chr(123) || chr(123) || 'tpl|1'
    || chr(125) || chr(125) || 'a  b' || chr(9) || {NL} || 'end'
    || CASE WHEN doc_id % 17 = 6 THEN ' Irminsul' ELSE '' END AS markdown,
  {d.arr(
      section("title", "1", f"{heading} || substr(text, 1, {third})"),
      section(pick("doc_id % 4", ["'Profile'", "'Trivia'", "'Gallery'", "''"]), "2",
              f"'## part' || {NL} || substr(text, {third} + 1, {third})"),
      section("'Story'", "2", f"substr(text, 2 * {third} + 1)"),
      section("'Gallery'", "2", "'![only](an/image.png)'"))} AS sections
FROM (
  SELECT doc_id, text, lang, source,
    CASE WHEN doc_id % 7 = 0 THEN 'https://h.example/p/' || {key}
      ELSE 'https://h.example/wiki/' || upper(lang) || '_Page%20' || {key}
        || CASE WHEN doc_id % 5 = 0 THEN '/Lore+A' ELSE '' END END AS url,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN {pick("doc_id % 9", aliases)}
      WHEN doc_id % 6 = 0 THEN ' "Page ' || {key} || '" ' ELSE 'Page ' || {key} END AS title,
    {pick("doc_id % 23", [d.arr(*map(lit, names)) for names in CATEGORY_LISTS])} AS kind_list,
    {pick("doc_id % 13", regions)} AS region_list,
    CASE WHEN doc_id % 19 = 3 THEN {d.arr("'Eremite Camps'")} ELSE {d.arr()} END AS extra_list
  FROM {d.table('documents')}
) base"""


def clean_wiki(d: SparkDialect) -> str:
    """Documents in the shape the later stages read: one canonical name, aliases and a type."""
    key = "CAST(doc_id AS STRING)"
    types = ["'PlayableCharacter'", "'Character'", "'NPC'", "'Enemy'", "'Location'", "'Quest'",
             "'Weapon'", "'Book'", "'Item'", "'Event'", "'Food'", "'Other'", "'Legend'", "'Concept'"]
    return f"""
SELECT doc_id, 'wiki_' || {key} AS page_key, text AS content, lang,
  CASE WHEN doc_id % 13 = 0 THEN 'NATION_' || CAST(doc_id % 25 AS STRING)
       WHEN doc_id % 13 = 1 THEN 'Tales of NATION_' || CAST(doc_id % 25 AS STRING) || ' retold'
       ELSE 'Page ' || {key} END AS canonical_name,
  CASE WHEN doc_id % 13 = 2 THEN {d.arr("'Old NATION_' || CAST(doc_id % 25 AS STRING)", f"'Page ' || {key}")}
       WHEN doc_id % 13 = 3 THEN {d.arr(f"'Alias ' || {key}")}
       ELSE {d.arr()} END AS aliases,
  {pick("doc_id % 14", types)} AS entity_type,
  {d.arr("'Region ' || upper(lang)")} AS regions,
  'https://h.example/wiki/' || {key} AS source_url
FROM {d.table('documents')}"""


def kg_nodes(d: SparkDialect) -> str:
    def part(table: str, key: str, name: str, kind: str, slot: int) -> str:
        return f"""
SELECT {name} AS name, '{kind}' AS type,
  CASE WHEN {key} % 9 = 0 THEN '' WHEN {key} % 9 = 1 THEN NULL
    ELSE '{kind} ' || {name} || repeat(' lore', CAST({key} % 60 AS INT)) END AS description,
  '{table}_' || CAST({key} AS STRING) AS source_doc_id, {name} AS source_title,
  CAST({key} AS BIGINT) * 16 + {slot} AS pos, CAST({key} AS BIGINT) AS item_key
FROM {d.table(table)}"""

    return " UNION ALL ".join([
        part("region", "r_regionkey", "r_name", "Location", 0),
        part("nation", "n_nationkey", "n_name", "Location", 2),
        part("supplier", "s_suppkey", "s_name", "Organization", 4),
        part("customer", "c_custkey", "c_name", "Character", 6),
        part("part", "p_partkey", "p_name || ' #' || CAST(p_partkey AS STRING)", "Item", 8),
        part("orders", "o_orderkey", "'Order ' || CAST(o_orderkey AS STRING)", "Event", 10),
    ])


def kg_mentions(d: SparkDialect) -> str:
    """Nodes as extracted: some entities were seen twice, the second time described at length."""
    return f"""
SELECT name, type, description, source_doc_id, source_title, pos FROM {d.table('kg_nodes')} a
UNION ALL
SELECT name, 'Concept' AS type, coalesce(description, '') || ' seen again' AS description,
  'again_' || source_doc_id AS source_doc_id, source_title, pos + 1 AS pos
FROM {d.table('kg_nodes')} b WHERE item_key % 4 = 0"""


def nation_name(key: str) -> str:
    return f"'NATION_' || CAST({key} AS STRING)"


def supplier_name(key: str) -> str:
    return f"'Supplier#' || lpad(CAST({key} AS STRING), 9, '0')"


def customer_name(key: str) -> str:
    return f"'Customer#' || lpad(CAST({key} AS STRING), 9, '0')"


def edge(source: str, key: str, head: str, relation: str, tail: str, slot: int, prefix: str) -> str:
    """Edges of one table; names of referenced rows follow from their keys, so nothing is joined."""
    return f"""
SELECT {head} AS head, {relation} AS relation, {tail} AS tail,
  CASE WHEN {key} % 5 = 0 THEN NULL ELSE repeat('x ', CAST({key} % 60 AS INT)) END AS evidence,
  '{prefix}_' || CAST({key} AS STRING) AS source_doc_id, CAST({key} AS BIGINT) * 16 + {slot} AS pos,
  CAST({key} AS BIGINT) AS item_key
FROM {source}"""


def core_edges(d: SparkDialect) -> str:
    """Region, nation and supplier edges; the supplier rings give cycles."""
    count = f"(SELECT count(*) FROM {d.table('supplier')})"
    supplier = d.table("supplier")
    nations = f"{d.table('nation')} n JOIN {d.table('region')} r ON r_regionkey = n_regionkey"
    return " UNION ALL ".join([
        edge(nations, "n_nationkey", "n_name", "'PART_OF'", "r_name", 0, "nation"),
        edge(supplier, "s_suppkey", "s_name", "'LOCATED_IN'", nation_name("s_nationkey"), 1, "supplier"),
        edge(supplier, "s_suppkey", "s_name", "'ALLY_OF'", supplier_name(f"((s_suppkey + 1) % {count})"), 2, "supplier"),
        edge(supplier, "s_suppkey", "s_name", "'ENEMY_OF'", supplier_name(f"((s_suppkey * 3 + 1) % {count})"), 3, "supplier"),
    ])


def kg_edges(d: SparkDialect) -> str:
    count = f"(SELECT count(*) FROM {d.table('supplier')})"
    kinds = pick("c_custkey % 5", ["'RELATED_TO'", "'KNOWS_OF'", "'TRANSFORMED_INTO'", "'AFFILIATED_WITH'", "'SEALED'"])
    return " UNION ALL ".join([
        core_edges(d),
        edge(d.table("customer"), "c_custkey", "c_name", "'LOCATED_IN'", nation_name("c_nationkey"), 4, "customer"),
        edge(d.table("customer"), "c_custkey", "c_name", kinds, supplier_name(f"(c_custkey % {count})"), 5, "customer"),
        edge(d.table("part"), "p_partkey", supplier_name(f"(p_partkey % {count})"), "'POSSESSES'",
             "p_name || ' #' || CAST(p_partkey AS STRING)", 6, "part"),
        edge(d.table("orders"), "o_orderkey", "'Order ' || CAST(o_orderkey AS STRING)", "'ORIGINATED_FROM'",
             customer_name("o_custkey"), 7, "orders"),
    ])


def kg_triples(d: SparkDialect) -> str:
    """Edges as extracted: some with a blank part or an unknown end, some seen twice."""
    return f"""
SELECT CASE WHEN item_key % 50 = 7 THEN '' ELSE head END AS head,
  CASE WHEN item_key % 50 = 8 THEN NULL ELSE relation END AS relation,
  CASE WHEN item_key % 50 = 0 THEN 'Missing ' || CAST(item_key AS STRING) ELSE tail END AS tail,
  evidence, source_doc_id, pos * 2 AS pos
FROM {d.table('kg_edges')} a
UNION ALL
SELECT head, relation, tail, 'second reading' AS evidence, 'again_' || source_doc_id AS source_doc_id,
  pos * 2 + 1 AS pos
FROM {d.table('kg_edges')} b WHERE relation = 'LOCATED_IN'"""


def alias_texts(d: SparkDialect) -> str:
    """One description per customer; every alias pattern occurs, every fifth alias is another name."""
    k = "CAST(c_custkey AS STRING)"
    other = f"CASE WHEN c_custkey % 5 = 0 THEN {customer_name('(c_custkey + 1)')} ELSE 'Nick ' || {k} END"
    phrases = [
        f"'is a trader also known as \"' || {other} || '\", a friend.'",
        f"'was also called Caller {k[:0]}' || chr(65 + CAST(c_custkey % 26 AS INT)) || ', once.'",
        f"'was known as ' || {other} || '. It was nicknamed The.'",
        "'goes by the name Silent Wanderer, and by her name Wind.'",
        f"'was formerly called Old ' || chr(65 + CAST(c_custkey % 26 AS INT)) || ', formerly Young One.'",
        f"'was nicknamed ' || {other} || ', nicknamed 12345678.'",
        "'uses the alias Grey Fox, his alias Z.'",
        f"'has the real name is Hidden ' || chr(65 + CAST(c_custkey % 26 AS INT)) || ', true name Bright.'",
        "'is one whose name was Long Forgotten. Nothing else.'",
        "'was originally named First Light, originally called Dawn.'",
        "'is titled Keeper of Gates, with the title Warden.'",
        "'was the Stone Sage and an Iron Archon of lore.'",
    ]
    return f"""
SELECT c_custkey AS entity_key, c_name AS name,
  c_name || ' ' || {pick('c_custkey % 12', phrases)} AS description
FROM {d.table('customer')}"""


def questions(d: SparkDialect) -> str:
    a = "'NATION_' || CAST(p_partkey % 25 AS STRING)"
    b = "'NATION_' || CAST((p_partkey * 7 + 3) % 25 AS STRING)"
    texts = [
        f"'What is the relationship between ' || {a} || ' and ' || {b} || '?'",
        f"'Why did ' || {a} || ' leave ' || {b} || '?'",
        f"'List every supplier in ' || {a}",
        f"'What is the difference between ' || {a} || ' and ' || {b} || '?'",
        f"'Who is ' || {a} || '?'",
        f"{a} || ' 与 ' || {b} || ' 有什么联系?'",
        f"'How did ' || {a} || ' eventually affect ' || {b} || ' through ' || p_name || '?'",
    ]
    names = [d.arr(a, b), d.arr(a, b), d.arr(a), d.arr(a, b), d.arr(a), d.arr(a, b), d.arr(a, b, "p_name")]
    layers = [d.arr("'A'"), d.arr("'A'"), d.arr("'A'", "'B'"), d.arr("'A'", "'B'", "'C'")]
    return f"""
SELECT CAST(p_partkey AS BIGINT) AS k, 'Q' || CAST(p_partkey AS STRING) AS question_id,
  CAST(1 + p_partkey % 4 AS INT) AS tier, {pick('p_partkey % 7', texts)} AS question,
  {pick('p_partkey % 7', names)} AS entities, {pick('p_partkey % 4', layers)} AS layers
FROM {d.table('part')}"""


def messages(d: SparkDialect) -> str:
    """Conversations with times and with user texts that refer back."""
    step = "CASE WHEN turn % 3 = 2 THEN 4200 ELSE 300 END"
    seconds = f"""1704067200 + conv_id * 600
    + CAST(sum({step}) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT)"""
    return f"""
SELECT conv_id, turn, role, text, entities, ts_s, {d.ts('ts_s')} AS ts FROM (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'user' AND turn < 2 THEN 'Who is NATION_' || CAST(conv_id % 25 AS STRING) || '?'
         WHEN role = 'user' AND turn % 3 = 0 THEN 'Is NATION_' || CAST((conv_id + 1) % 25 AS STRING) || ' near them?'
         WHEN role = 'user' THEN 'What is her role?' ELSE text END AS text,
    CASE WHEN turn % 4 = 2 THEN {d.arr()}
         WHEN turn % 4 = 3 THEN {d.arr("'NATION_' || CAST((conv_id + 1) % 25 AS STRING)", "'REGION ' || CAST(conv_id % 5 AS STRING)")}
         ELSE {d.arr("'NATION_' || CAST(conv_id % 25 AS STRING)")} END AS entities,
    {seconds} AS ts_s
  FROM {d.table('conversations')}
) m"""


def turns(d: SparkDialect) -> str:
    """Question and answer pairs of a conversation in order."""
    return f"""
SELECT conv_id AS session_id,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn_no,
  CASE WHEN before_role = 'user' THEN before_text ELSE '(unknown)' END AS question,
  text AS answer, entities, ts_s, ts,
  {pick('turn % 4', ["'FACTUAL'", "'RELATIONSHIP'", "''", "'MULTI_HOP'"])} AS query_type
FROM (
  SELECT conv_id, turn, role, text, entities, ts_s, ts,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before_text
  FROM {d.table('messages')} x
) y WHERE role = 'assistant'"""


def cache_entries(d: SparkDialect) -> str:
    key = "CAST(vec_id AS STRING)"
    source = lambda n: d.struct(
        title=f"'Page ' || CAST(vec_id + {n} AS STRING)", score=f"CAST(0.5 + {n} / 10.0 AS DOUBLE)",
        full_text=f"repeat('passage {n} ', CAST(vec_id % 90 AS INT))",
        regions=f"CASE WHEN vec_id % 2 = 0 THEN {d.arr(lit('East'), lit('West'))} ELSE {d.arr()} END")
    return f"""
SELECT CAST(vec_id AS BIGINT) AS entry_id, embedding, label,
  CASE WHEN vec_id % 10 = 0 THEN 'zh' ELSE 'en' END AS lang,
  'Question ' || {key} AS question, 'Answer ' || {key} AS answer,
  CASE WHEN vec_id % 4 = 0 THEN {d.arr(source(1), source(2))} ELSE {d.arr(source(3))} END AS sources,
  1704067200 + CAST(vec_id AS BIGINT) * 1800 AS ts_s
FROM {d.table('embeddings')}"""


def cache_lookups(d: SparkDialect) -> str:
    """Every vector asked again: as it was, slightly changed, or with half its signs turned."""
    slight = d.each("embedding", "CAST(x AS DOUBLE) * (1 + 0.02 * ((i + vec_id) % 5))".replace(
        "(i + ", "({i} + " if isinstance(d, DuckDialect) else "(i + "))
    turned = d.each("embedding", "CAST(x AS DOUBLE) * (1 - 2 * ({i} % 2))" if isinstance(d, DuckDialect)
                    else "CAST(x AS DOUBLE) * (1 - 2 * (i % 2))")
    same = d.each("embedding", "CAST(x AS DOUBLE)")
    return f"""
SELECT CAST(vec_id AS BIGINT) AS query_id, CASE WHEN vec_id % 7 = 3 THEN 'zh' ELSE 'en' END AS lang,
  CASE vec_id % 3 WHEN 0 THEN {same} WHEN 1 THEN {slight} ELSE {turned} END AS embedding
FROM {d.table('embeddings')}"""


def configs(d: SparkDialect) -> str:
    rows = []
    for prefix, model, classifier in (("S4", "claude-sonnet-4-20250514", "claude-3-haiku-20240307"),
                                      ("G4", "gpt-4o", "gpt-4o-mini")):
        for strategy, vector, graph in (("LLM", "false", "false"), ("VEC", "true", "false"),
                                        ("GRF", "false", "true"), ("HYB", "true", "true")):
            expansion = "true" if strategy == "HYB" else "false"
            rows.append(f"({len(rows)}, '{prefix}-{strategy}', '{model}', '{classifier}', {vector}, {graph}, {expansion})")
    return f"""
SELECT * FROM (VALUES {', '.join(rows)})
  AS v(c, config, model, classifier, use_vector, use_graph, use_expansion)"""


def gold(d: SparkDialect) -> str:
    """Gold record per question: three to eight facts, up to three traps."""
    fact = d.struct(
        fact="'fact ' || CAST({i} AS STRING) || CASE WHEN ({i} + k) % 4 = 0 THEN ' in 12 年' WHEN ({i} + k) % 7 = 0 THEN ' Harbinger' ELSE '' END",
        verified="(({i} + k) % 5 <> 0)")
    trap = d.struct(trap="'trap ' || CAST({i} AS STRING)", correct="'right ' || CAST({i} AS STRING)")
    if not isinstance(d, DuckDialect):
        fact, trap = fact.replace("{i}", "i"), trap.replace("{i}", "i")
    facts = d.each(d.seq("1", "CAST(3 + k % 6 AS INT)"), fact)
    traps = d.each(d.only(d.seq("1", "3"), "x <= k % 4"), trap)
    return f"""
SELECT k, question_id, tier, {facts} AS key_facts, {traps} AS hallucination_traps,
  CAST(1 + k % 3 AS INT) AS min_acceptable_facts,
  CASE WHEN k % 6 = 0 THEN 'None' WHEN k % 6 = 1 THEN 'gap in ' || question ELSE 'none' END AS coverage_notes,
  (k % 31 = 0) AS parse_error
FROM {d.table('questions')} q"""


def runs(d: SparkDialect) -> str:
    """Every configuration's answer to every question, with the judge's raw reply."""
    covered = d.only(d.seq("0", "CAST(2 + k % 6 AS INT)"), "(x * (c + 1) + k) % 3 = 0")
    triggered = d.only(d.seq("0", "2"), "x < k % 4 AND (x + c + k) % 5 = 0")
    odd = d.arr("0", "0", "99")
    reply = f"""chr(123) || '"facts_covered": [' || {d.join('covered', ', ')} || CASE WHEN k % 5 = 2 THEN ', 0,' ELSE '' END
    || '], "traps_triggered": [' || {d.join('triggered', ', ')} || '], "reasoning": "config ' || CAST(c AS STRING) || '"' || chr(125)"""
    return f"""
SELECT k, c, question_id, question, tier, config, model, covered, triggered, answer, error, tokens_in,
  tokens_out, cached_in, written_in, seconds, attempt,
  CASE WHEN k % 19 = 0 THEN substr(reply, 1, length(reply) - 12)
       WHEN k % 4 = 1 THEN '```json' || {NL} || reply || {NL} || '```'
       WHEN k % 4 = 2 THEN 'Here it is: ' || reply || ' Done.' ELSE reply END AS raw
FROM (SELECT *, {reply} AS reply FROM (
  SELECT k, c, question_id, question, tier, config, model, attempt,
    CASE WHEN k % 9 = 0 THEN {d.cat(covered, odd)} ELSE {covered} END AS covered,
    {triggered} AS triggered,
    CASE WHEN (k + c) % 17 = 0 THEN NULL
         ELSE 'It began in ' || question_id || '. The tale holds [Source: Page ' || CAST(k AS STRING)
           || '] and more. Then it ended [Source: Page ' || CAST(k + c AS STRING) || '] [Relation: A to B].' END AS answer,
    CASE WHEN (k + c) % 23 = 0 THEN 'timeout' ELSE NULL END AS error,
    1000 + (k * 7 + c * 13) % 500 AS tokens_in, 100 + (k * 3 + c) % 90 AS tokens_out,
    (k + c) % 3 * 100 AS cached_in, (k + c) % 4 * 50 AS written_in, CAST((k * 3 + c) % 70 AS DOUBLE) / 10 AS seconds
  FROM {d.table('questions')} q CROSS JOIN {d.table('configs')} v
    JOIN (VALUES (0), (1)) AS r(attempt) ON attempt = 0 OR k % 8 = 0
) s) t"""


VIEWS = {
    f.__name__: f for f in (
        wiki, clean_wiki, kg_nodes, kg_mentions, core_edges, kg_edges, kg_triples, alias_texts,
        questions, messages, turns, cache_entries, cache_lookups, configs, gold, runs,
    )
}


def spark_view(tables, name: str) -> DataFrame:
    return tables.spark.sql(VIEWS[name](SparkDialect(tables.sql_name)))


def with_views(names: list[str], body: str) -> str:
    """An oracle statement that carries the views it reads."""
    if not names:
        return body
    duck = DuckDialect()
    ctes = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n](duck)})" for n in names)
    body = body.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return f"{opening}{ctes}, {body[len(opening):]}"
    return f"WITH {ctes} {body}"
