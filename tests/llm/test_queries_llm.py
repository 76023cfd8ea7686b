"""Registered queries against their DuckDB statements, and the pipeline against its stages done plainly."""

import pytest
from compare import compare
from llm.conftest import brute_components
from llm.test_operators_llm import py_print

from conftest import DATA
from corpusloom.llm import pii
from corpusloom.llm.queries import ORACLES, QUERIES, vocabulary


class _Entry:
    def __init__(self, name):
        self.name, self.sql = name, ORACLES.get(name)

    def run(self, spark, folder):
        return QUERIES[self.name](spark, folder)

    def oracle(self):
        return self.sql


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    result = compare(spark, oracle, name, _Entry(name), DATA)
    assert result["status"] in ("ok", "rows-only") and result["rows"] > 0, result


def test_pipeline(spark, tables):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from corpusloom.llm import quality

    docs = tables.documents
    good = {r.doc_id for r in quality.scored(docs, tables.labels).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    prints = {i: py_print(t) for i, t in texts.items()}
    roots = brute_components(prints, [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4])
    left = {i: pii.masked(texts[i], pii.spans(texts[i])[1]) for i in texts if roots[i] == i}
    library, rows = Tokenizer.from_file(vocabulary()), corpus_pipeline.run(spark, DATA).collect()
    assert rows and {r.doc_id for r in rows} <= set(left)
    for r in rows:
        assert r.ids == library.encode(left[r.doc_id], add_special_tokens=False).ids
    size = lambda t: len(t.split())
    assert sum(size(left[r.doc_id]) for r in rows) == pytest.approx(1.5 * sum(map(size, left.values())), rel=0.1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_rollup_query_equals_a_recount(spark, tables):
    from collections import Counter

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    seen, docs, tokens = set(), Counter(), Counter()
    for r in tables.documents.orderBy("doc_id").collect():
        if (r.text or "") not in seen:
            seen.add(r.text or "")
            docs[r.source, r.lang] += 1
            tokens[r.source, r.lang] += len(library.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): (r.version, r.n_docs, r.n_tokens) for r in QUERIES["op3_token_rollup"](spark, DATA).collect()}
    assert got == {k: ("word_bpe_49k", docs[k], tokens[k]) for k in docs}


def test_contract():
    import __spark_entry__ as driver
    import corpus_pipeline

    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
