"""Every opN_ query on the driver's smallest tables: against its SQL, or a brute-force version of its contract."""

import hashlib
import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

from scrivener.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def documents(spark: SparkSession):
    return {x.doc_id: x.text or "" for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    flat = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(str).replace("nan", "None").replace("<NA>", "None").values))
    assert flat(got) == flat(want) and len(got)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else ())


def test_op1(spark, documents):
    sets = {i: shingles(t) for i, t in documents.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = rows(spark, "op1_minhash_dedup")
    assert {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got} == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()} and len(got) == len(sets)


def test_op2(spark, documents):
    order = sorted(documents, reverse=True)
    got = {x.doc_id: x for x in rows(spark, "op2_fingerprints")}
    assert len(got) == len(documents)
    jaccard = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) if shingles(a) | shingles(b) else 1.0
    off, by_text = [], {}
    for k, i in enumerate(order):
        text, after, half = documents[i], documents[order[(k + 1) % len(order)]], len(documents[i]) // 2
        new, x = text[: len(text) - half] + after[:half], got[i]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert by_text.setdefault(text, x.fingerprint) == x.fingerprint
        off += [x.near_edited - jaccard(text, new), x.near_next - jaccard(text, after)]
    assert np.sqrt(np.mean(np.square(off))) < 0.04 and np.abs(off).max() < 0.2


def test_op4(spark):
    table = {x.vec_id: np.array(x.embedding, float) for x in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    ids = np.array(sorted(table))
    unit = np.stack([table[i] / np.linalg.norm(table[i]) for i in ids])
    got = {}
    for x in sorted(rows(spark, "op4_nearest"), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for k in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[k]
        s[k] = -9
        best = np.lexsort((ids, -s))[:5]
        assert [(r, v) for r, v, _ in got[ids[k]]] == [(r + 1, int(ids[b])) for r, b in enumerate(best)]
        assert np.allclose([x for *_, x in got[ids[k]]], s[best], atol=1e-12, rtol=0)


def test_op5(spark, documents):
    toxic = {x.doc_id: x.toxic for x in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = rows(spark, "op5_toxicity")
    assert len(got) == len(documents)
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
        assert all(s in documents[x.doc_id] for s in x.offending.split("\n"))
    held = [(x.predicted, toxic[x.doc_id]) for x in got if x.held_out and x.doc_id in toxic]
    assert sum(a != b for a, b in held) <= 0.1 * len(held)


def test_op7(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op7_bpe")
    assert len(got) == len(documents)
    for x in got:
        ids = t.encode(documents[x.doc_id], add_special_tokens=False).ids
        plain = t.decode(ids, skip_special_tokens=False)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())


def test_op10(spark, documents):
    seen, want = {}, set()
    for i in sorted(documents):
        w = WORD.findall(documents[i])
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want.add((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = rows(spark, "op10_substring_dedup")
    assert {(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got} == want and len(got) == len(documents)
    assert sum(x.n_removed for x in got) > 0
