"""Registered training-data queries against their DuckDB statements, and the pipeline."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hushscan.llm import mixing, pieces, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_operator_has_a_query():
    named = [re.match(r"op(\d+)_", name)[1] for name in queries.QUERIES]
    assert sorted(map(int, named)) == list(range(1, 14))
    assert set(queries.QUERIES) <= set(entry.queries()) and entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(queries.STATEMENTS))
def test_query(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF):
        if file.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    result = connection.execute(queries.STATEMENTS[name])
    columns = [d[0] for d in result.description]
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((tuple(clean(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()), key=repr)
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted((tuple(clean(r[c]) for c in sorted(columns)) for r in frame.collect()), key=repr) == want and want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.STATEMENTS)))
def test_query_covers_its_table(spark, name):
    table, key = {"op4": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    rows = queries.QUERIES[name](spark, SF).collect()
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    if name.startswith("op1_"):
        assert {i for r in rows for i in r.doc_ids} == ids
    elif name.startswith("op13_"):
        assert sorted((r.vec_id, r.component) for r in rows) == [(i, c) for i in sorted(ids) for c in range(1, 9)]
    else:
        assert sorted(r[key] for r in rows) == sorted(ids)


def plain_near_duplicates(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [r for r in rows if root(r["doc_id"]) == r["doc_id"]]


def plain_cut(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(window)
        text, at = "", 0
        for char in r["text"] or "":
            size = len(char.encode())
            text += "" if all(gone[at : at + size]) else char
            at += size
        out.append({**r, "text": text if r["text"] else r["text"], "n_chars": len(text)})
    return out


def test_pipeline_against_plain_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "minhash near-dedup", "suffix-array dedup", "source mixing", "piece encoding"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(100_000 + i, t, "en", "src0", 1) for i, t in enumerate([None, "", "12 34 !!", "x" * 3, "Only letters here."])]
    docs = given.unionByName(spark.createDataFrame(extra, DOCS))
    run = [f for _, f in corpus_pipeline.STAGES]
    columns = given.columns

    told = run[0](spark, docs, SF)
    kept = [r.asDict() for r in told.collect()]
    assert told.columns == columns
    letters = lambda t: t is not None and any(c.isalpha() for c in t)
    assert sorted(r["doc_id"] for r in kept) == sorted(r.doc_id for r in docs.collect() if letters(r.text))

    single = run[1](spark, told, SF)
    assert single.columns == columns
    want = plain_near_duplicates(kept)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r["doc_id"] for r in want) and len(want) < len(kept)

    cut = run[2](spark, single, SF)
    assert cut.columns == columns
    want = plain_cut(want)
    assert sorted(map(tuple, cut.collect()), key=repr) == sorted((tuple(r[c] for c in columns) for r in want), key=repr)

    mixed = run[3](spark, cut, SF)
    assert mixed.columns == columns
    rows = mixed.collect()
    taken = {r.doc_id: r.taken for r in mixing.curriculum(cut).collect()}
    used = {}
    for r in rows:
        used[r.doc_id] = used.get(r.doc_id, 0) + len((r.text or "").split())
        assert r.n_chars == len(r.text)
    assert used == {i: n for i, n in taken.items() if n}

    coded = run[4](spark, mixed, SF).collect()
    v = pieces.Vocabulary.load()
    assert sorted((r.doc_id, v.decode(r.ids)) for r in coded) == sorted((r.doc_id, r.text) for r in rows)
    assert all(r.lossless for r in coded)


def test_pipeline_runs_whole_and_on_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 50
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
