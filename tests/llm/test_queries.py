"""Registered queries against their SQL, and the pipeline's stages on odd input."""

import duckdb
import pytest

import corpus_pipeline
from factorloom.llm import queries
from factorloom.llm.common import read
from factorloom.llm.line_dedup import LEAST, SURE

from .helpers import ODD, docs, line_dedup, near_duplicates, repeated, shingles, words
from .test_operators import line_hash


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    plain = lambda df: sorted(tuple("" if x is None or x != x else str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x) for x in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))
    assert plain(ours) == plain(theirs)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, sf):
    found, d = {}, read(spark, sf, "documents")
    found["documents"] = d
    for name, stage in corpus_pipeline.STAGES:
        found[name] = d = corpus_pipeline.written(stage(spark, d, sf), name)
    return found


def test_stages_act_on_what_the_one_before_kept(stages):
    d = stages["documents"]
    for name in ("quality_classifier", "line_dedup", "near_dedup", "mixing"):
        assert stages[name].columns == d.columns
    before = [(r["doc_id"], r["text"]) for r in stages["quality_classifier"].orderBy("doc_id").collect()]
    gone, want = line_dedup(before, LEAST, SURE, line_hash), {}
    for k, text in before:
        left = [x for i, x in enumerate(words(text)) if i not in gone[k]]
        if left or not gone[k]:
            want[k] = left
    after = {r["doc_id"]: r["text"] for r in stages["line_dedup"].collect()}
    assert {k: words(t) for k, t in after.items()} == want
    # as they are and as they were: a document's two texts are one document
    both = [*after.items(), *((k, t) for k, t in before if k in after and after[k] != t)]
    group, root = {}, {}
    for (k, _), (_, n, c) in zip(both, near_duplicates([(i, t) for i, (_, t) in enumerate(both)], 5, 80), strict=True):
        if n:
            group.setdefault(k, []).append(c)

    def top(g):
        while root.get(g, g) != g:
            g = root[g]
        return g

    for own in group.values():
        for g in own[1:]:
            a, b = sorted((top(own[0]), top(g)))
            root[b] = a
    least = {}
    for k in sorted(group):
        least.setdefault(top(group[k][0]), k)
    kept = {k for k in after if not shingles(after[k], 5) or least[top(group[k][0])] == k}
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == kept
    mixed = {r["doc_id"] for r in stages["mixing"].collect()}
    assert mixed <= kept and {r["doc_id"] for r in stages["best_fit_packing"].collect()} == mixed


def test_labels_decide_what_goes_first(spark, sf, stages):
    bad = read(spark, sf, "labels").groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "q").filter("q = 0")
    left = stages["quality_classifier"].join(bad, "doc_id").count()
    assert left <= 0.1 * bad.count()


def test_good_documents_stay(spark, sf, stages):
    """Of documents that are labelled good, nearly all pass the classifier; after it only repetition takes any away."""
    good = read(spark, sf, "labels").groupBy("doc_id").agg({"quality": "min"}).toDF("doc_id", "q").filter("q = 1")
    assert stages["quality_classifier"].join(good, "doc_id").count() >= 0.95 * good.count()
    before = {r["doc_id"]: r["text"] for r in stages["quality_classifier"].collect()}
    after = {r["doc_id"]: r["text"] for r in stages["line_dedup"].collect()}
    fresh = repeated(sorted(before.items()), LEAST)
    assert all(after.get(d) == t for d, t in before.items() if not fresh[d])


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["best_fit_packing"].count()


def test_documents_with_own_text_stay_and_near_copies_go(spark, sf, monkeypatch):
    """Document 2 copies half its words from 1 and has short stretches of its own; 3 is 1 with a few words changed; 4 is 1 alone."""
    passages = [[f"p{k}_{i}" for i in range(45)] for k in range(4)]
    own = [[f"own{k}_{i}" for i in range(38)] for k in range(4)]
    first = sum(passages, [])
    mixed = sum((p + o for p, o in zip(passages, own, strict=True)), [])
    edited = [f"new{i}" if i % 60 == 30 else w for i, w in enumerate(first)]
    table = docs(spark, [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in enumerate([first, mixed, edited, first], 1)])
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: table)
    cut = corpus_pipeline.line_dedup(spark, table, sf)
    left = {r["doc_id"]: words(r["text"]) for r in cut.collect()}
    assert sorted(left) == [1, 2, 3] and left[2] == [w.encode() for o in own for w in o] and 0 < len(left[3]) < 40
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.written(cut, "cut"), sf).collect()) == [1, 2]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, sf, rows):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, rows), sf).count() <= 4 * len(rows) + 300
