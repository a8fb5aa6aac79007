"""Queries without SQL leave out no rows and no part of a text: all rows of the small tables against plain versions."""

import hashlib

import duckdb
import pytest

from factorloom.operators import diagnostics, model, text
from factorloom.plans import registry

QUERIES = registry.queries()


def plain_chunks(text, most):
    done, chunk = [], ""
    for p in (x.strip() for x in text.split("\n")):
        if not p:
            continue
        joined = f"{chunk}\n\n{p}" if chunk else p
        if len(joined) <= most:
            chunk = joined
        else:
            *more, last = [p[i : i + most] for i in range(0, len(p), most)]
            done, chunk = [*done, *([chunk] if chunk else []), *more], last
    return [*done, chunk] if chunk else done


def test_chunks_hold_whole_texts(spark, sf):
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = sorted((d, i, len(c)) for d, t in docs for i, c in enumerate(plain_chunks(t, 500)))
    assert max(i for _, i, _ in want) >= 12
    assert sorted(tuple(r) for r in QUERIES["text_chunks"](spark, sf).collect()) == want


def test_chunks_trim_spaces_and_no_digits(spark):
    df = spark.createDataFrame([("0 a0\n\n 1b1 \n\n2",)], "t string")
    assert df.select(text.chunks_of("t", 5)).first()[0] == ["0 a0", "1b1", "2"] and df.select(text.chunks_of("t", 6, 1)).first()[0] == ["0 a0"]


def test_tidy_lines_of_odd_texts(spark, tmp_path):
    texts = [(1, "a\r\n b \rc"), (2, ""), (3, "  \n \n"), (4, None), (5, "x\n\ny"), (6, "0 of\n1 and 1")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["tidy_sha256"]) for r in QUERIES["text_tidy_lines"](spark, str(tmp_path)).collect()}
    lines = {1: ["a", "b", "c"], 2: [], 3: [], 4: [], 5: ["x", "y"], 6: ["0 of", "1 and 1"]}
    assert got == {d: (len(x), hashlib.sha256("\n".join(x).encode()).hexdigest()) for d, x in lines.items()}


class Seen(Exception):
    pass


@pytest.mark.parametrize(("name", "module", "operator"), [("look_ahead_check", diagnostics, "look_ahead"), ("model_boosted", model, "train_boosted"), ("parameter_scores", model, "score_parameters")])
def test_parameters_are_not_below_the_operators_own(spark, sf, monkeypatch, name, module, operator):
    def seen(*args, **named):
        raise Seen(args, named)

    monkeypatch.setattr(module, operator, seen)
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, sf)
    args, named = found.value.args
    assert not named.keys() & {"cuts", "rounds", "depth"}
    if operator == "score_parameters":
        assert not any("rounds" in p for p in args[3])
