"""Each operator against a brute-force version on small fixtures that hold the awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivener.llm import ann, bpe, fingerprints, licenses, minhash, mixing, sharding, substring, toxicity, warc
from scrivener.llm.store import components, ranked

WORD = re.compile("[^\x20\x09-\x0d]+")
RNG = random.Random(11)
NAMES = ["".join(RNG.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(NAMES) for _ in range(n))


def edit(text, n, rng=RNG):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(NAMES)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    """Texts with copies, near copies, shared passages, and null, empty, blank, short, long and odd ones."""
    base = prose(120)
    rows = [base, base, *(edit(base, k) for k in (1, 1, 2, 3, 4, 5, 6, 8, 10, 14, 20))]
    passage = prose(60)
    rows += [prose(40) + " " + passage + " " + prose(30) for _ in range(6)]
    rows += [prose(n) for n in (3, 4, 5, 12, 13, 14, 60)] + [prose(3000), None, "", " \t\n", "one", "ONE", "a b c d", "a  b\tc\nd", "中文 字 é x <|endoftext|>"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(500, base), (500, base)]


def components_of(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in nodes}


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, texts):
    got = minhash.near_duplicates(docs(texts)).collect()
    sets = {}
    for i, t in texts:
        sets[i] = shingle_set(t)
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)


def test_near_duplicates_of_nothing_and_nulls(docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    rows = minhash.near_duplicates(docs([(None, "a b c d e f"), (None, None), (1, "a b c d e f")])).collect()
    assert {(x.doc_id, x.component_id, x.kept) for x in rows} == {(None, None, True), (1, 1, True)}


def test_near_duplicates_of_groups_around_the_threshold(docs, monkeypatch):
    """Many members about as far from each other as the threshold, none of them a hub; blocks of a few members; a doc_id with
    two texts of very different sizes, one of which links."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(5)
    rows = []
    for n, k in ((60, 1), (90, 2), (200, 4)):
        base = prose(n, rng)
        rows += [(len(rows) + 1 + i, edit(base, k + i % 2, rng)) for i in range(60)]
    short = prose(24, rng)
    rows += [(900, short), (901, short + " x"), (901, prose(800, rng)), (902, "y " + short + " x")]
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if a != b and 100 * len(s & t) >= 75 * len(s | t)]
    want = components_of({i for i, _ in rows}, links)
    assert 20 < len(set(want.values())) < 170
    got = minhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: x.component_id for x in got} == want


@pytest.mark.parametrize("cross", [False, True])
def test_block_links_join_what_all_links_join(cross):
    rng = random.Random(3)
    base = prose(80, rng)
    texts = [edit(base, rng.randrange(1, 5), rng) for _ in range(50)]
    words_ = [sorted(shingle_set(t)) for t in texts]
    code = {x: i for i, x in enumerate(sorted(set(itertools.chain(*words_))))}
    hashes = [np.array([code[x] for x in w], np.int64) for w in words_]
    mixed = [np.sort(minhash.mix(h.view(np.uint64) + np.uint64(1))) for h in hashes]
    regs = np.vstack([minhash.registers(minhash.minima(np.zeros(len(h), np.int64), h, 1)) for h in mixed])
    side = np.arange(50) % 2
    ok = lambda a, b: 100 * len({*hashes[a]} & {*hashes[b]}) >= 75 * len({*hashes[a]} | {*hashes[b]})
    every = [(a, b) for a, b in itertools.combinations(range(50), 2) if (not cross or side[a] != side[b]) and ok(a, b)]
    got = minhash.block_links(side, np.arange(50), np.zeros(50, np.int64), regs, hashes, cross, 75, 18.0)
    assert {tuple(sorted(x)) for x in got} <= {*every}
    assert components_of(range(50), got) == components_of(range(50), every)
    assert len(got) == 50 - len(set(components_of(range(50), every).values()))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**64, 3000, dtype=np.uint64), rng.integers(0, 2**64, 1000, dtype=np.uint64)
    sketch = lambda h: minhash.registers(minhash.minima(np.zeros(len(h), np.int64), np.sort(h), 1))
    assert (minhash.merge(sketch(a), sketch(b)) == sketch(np.concatenate([a, b]))).all()
    for share in (0.2, 0.5, 0.75, 0.95):
        est = []
        for _ in range(20):
            n = 1000
            common, own = rng.integers(0, 2**64, int(n * share), dtype=np.uint64), rng.integers(0, 2**64, (2, (n - int(n * share)) // 2), dtype=np.uint64)
            x, y = sketch(np.concatenate([common, own[0]])), sketch(np.concatenate([common, own[1]]))
            size = np.array([float(len(common) + own.shape[1])])
            est.append(minhash.estimate(x, y, size, size)[0][0])
        assert abs(np.mean(est) - share) < 0.03


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({x for p in links for x in p}, links)
    assert all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 3


def test_ranked(spark):
    got = ranked(spark.createDataFrame([(x,) for x in [5, 3, None, 9, -1]], "k long"), F.col("k").desc_nulls_last()).collect()
    assert {x.k: x["rank"] for x in got} == {9: 0, 5: 1, 3: 2, -1: 3, None: 4}


def test_fingerprints(docs, texts):
    rows = {i: t or "" for i, t in texts}
    got = {x.doc_id: x for x in fingerprints.edited(docs(texts)).collect()}
    order = sorted(rows, reverse=True)
    jaccard = lambda a, b: len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b)) if shingle_set(a) | shingle_set(b) else 1.0
    by_text, errors = {}, []
    for k, i in enumerate(order):
        text, nxt = rows[i], rows[order[(k + 1) % len(order)]]
        half = len(text) // 2
        new = text[: len(text) - half] + nxt[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        errors += [x.near_edited - jaccard(text, new), x.near_next - jaccard(text, nxt)]
        assert by_text.setdefault(text, x.fingerprint) == x.fingerprint
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.15
    assert fingerprints.edited(docs([])).count() == 0
    alone = fingerprints.edited(docs([(7, "abcd")])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_mixing(docs):
    rng = random.Random(9)
    rows = [(i, prose(rng.randrange(0, 60)), rng.choice(["a", "b", "c", "d", None, "é"])) for i in range(3000)] + [(5000, None, "a"), (5001, "", "zero"), (None, "x y", "b")]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    held, total = set(), sum(size.values())
    while True:
        rest, w = total - 3 * sum(size[s] for s in held), sum(weight[s] for s in names if s not in held)
        more = {s for s in names if s not in held and 3 * size[s] < weight[s] * rest / w}
        if not more:
            break
        held |= more
    target = {s: 3.0 * size[s] if s in held else weight[s] * rest / w for s in names}
    taken = dict.fromkeys(names, 0)
    for x in got:
        assert x.mix_target == pytest.approx(target[x.source]) and x.mix_source_size == size[x.source] and 0 <= x.mix_times <= 3
        taken[x.source] += x.mix_times * x.mix_size
    assert all(abs(taken[s] - target[s]) <= 60 for s in names)
    again = sorted((x.doc_id or -1, x.mix_times) for x in mixing.mix(docs(rows).repartition(7)).collect())
    assert again == sorted((x.doc_id or -1, x.mix_times) for x in got)
    assert mixing.mix(docs([])).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 15))
    x[100:180] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(4000, None), (4050, [0.0] * 15), (4100, [float("nan")] * 15), (4150, [1.0, None] + [0.0] * 13), (4200, [1.0]), (None, rows[0][1]), (50, rows[50][1]), (4250, [float("inf")] + [0.0] * 14), (4300, [1e-200] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = np.vstack([x, np.ones((1, 15))])
    ids = np.append(np.arange(3000), 4300)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    queries = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    for i in queries:
        s = unit @ unit[i]
        s[i] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        own = got[ids[i]]
        hits += len({v for v, _ in own} & set(ids[best]))
        assert [round(v, 12) for _, v in own] == sorted((round(v, 12) for _, v in own), reverse=True)
    assert hits / (5 * len(queries)) >= 0.9 and len(got) == len(queries)
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_nearest_inside_a_dense_group(spark):
    """Near copies, more than any short list of candidates holds, whose differences are below the error of the codes."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(600, 16)), rng.normal(size=16) + 1e-4 * rng.normal(size=(900, 16))])
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(0, len(x), 50):
        s = unit @ unit[i]
        s[i] = -9
        want |= {(i, int(v)) for v in np.argsort(-s)[:5]}
    got = {(r.query_id, r.vec_id) for r in ann.search(table, table.where("vec_id % 50 = 0")).collect()}
    assert len(got & want) / len(want) == 1.0


def test_toxicity(spark, docs):
    rng, bad = random.Random(6), ["zzvile", "zznasty", "zzawful"]
    rows, labels = [], []
    for i in range(900):
        sentences = [prose(8, rng) + "." for _ in range(rng.randrange(1, 40))]
        toxic = i % 6 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + " " + rng.choice(bad).title() + "!"
        rows.append((i, " ".join(sentences)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "..."), (None, "zzvile"), (5003, "fine words " * 5000)]
    labels += [(None, 1, 1), (5000, None, None), (9999, 0, 1)]
    table, known = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(table, known)
    got = {x.doc_id: x for x in toxicity.score(table, model).withColumn("h", toxicity.held_out()).collect()}
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    held = [i for i in range(900) if got[i].h]
    assert sum((got[i].predicted == 1) != (i % 6 == 0) for i in held) <= 0.02 * len(held)
    hit = next(got[i] for i in held if i % 6 == 0 and got[i].predicted)
    assert len(hit.offending) == 1 and any(b in hit.offending[0].lower() for b in bad)
    assert all(got[i].score == 0 and got[i].predicted == 0 for i in (5000, 5001, 5002)) and got[5003].predicted == 0 and got[None].predicted == 1
    blank = toxicity.train(table, known.limit(0))
    assert toxicity.score(table, blank).agg(F.max("predicted")).first()[0] == 0 and toxicity.score(docs([]), model).count() == 0


def test_warc_audit(spark):
    rows = [(i, f"http://x/{i % 3}", "é" * (i % 50)) for i in range(2500)] + [(None, None, None), (7, "u", "again"), (7, "u", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    broken = pages.withColumn("html", F.when(F.col("page_id").isin(3, 1500, 2400), F.lit("bad")).otherwise(F.col("html"))).where("page_id is null or page_id <> 9")
    got = warc.audit(pages, broken).collect()
    assert len(got) == len(rows) and {x.page_id for x in got if not x.intact} == {3, 9, 1500, 2400}
    files = {}
    for x in sorted(got, key=lambda x: (x.file, x.offset)):
        assert x.offset == files.setdefault(x.file, 0)
        files[x.file] += x.n_bytes
    assert all(x.intact for x in warc.audit(pages, pages).collect()) and warc.audit(pages.limit(0), pages).count() == 0


def test_warc_differences(spark):
    """Records that only the replica has, that lie elsewhere in it, or whose offset is wrong."""
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 7)) for i in range(1200)] + [(5000, "same", "")] * 3, "page_id long, url string, html string")
    found = lambda a, b: sorted((x.finding, x.page_id) for x in warc.differences(a, b).collect())
    assert found(pages, pages) == []
    more = spark.createDataFrame([(9000, "v", "z"), (5000, "same", "")], pages.schema)
    assert found(pages, pages.union(more)) == [("extra", 5000), ("extra", 9000)]
    assert [x for x in found(pages, pages.where("page_id <> 1100")) if x[0] != "moved"] == [("missing", 1100)]
    whole = warc.stored(pages).select("page_id", "file", "offset", "n_bytes").distinct()
    at = {x.page_id: (x.file, x.offset) for x in whole.where("page_id < 5000").collect()}
    placed = lambda change: spark.createDataFrame([(i, f"u{i}", "x" * (i % 7), *change.get(i, at[i])) for i in range(1200)], "page_id long, url string, html string, file long, offset long")
    alone = placed({})
    assert found(alone, placed({})) == []
    assert found(alone, placed({7: at[14], 14: at[7]})) == [("moved", 7), ("moved", 14)]
    assert found(alone, placed({1199: (at[1199][0], at[1199][1] + 5)})) == [("moved", 1199)]
    assert all(x.intact for x in warc.audit(alone, placed({7: at[14], 14: at[7]})).collect())


def test_bpe(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(900 + i, x) for i, x in enumerate(["a" * 3000, "aaaa aaa  aa \n\n x", "<|endoftext|>x <|endoftext|>", "🎉🎉👩‍👩‍👧", "don't I'VE", "\x00\x7f", "  " * 50])]
    odd += [(1000 + i, "".join(chr(RNG.choice([RNG.randint(32, 126), RNG.randint(0x80, 0x7FF), RNG.randint(0x4E00, 0x9FFF), RNG.randint(0x10000, 0x1FFFF)])) for _ in range(60))) for i in range(100)]
    rows = texts + odd
    got = bpe.encode(docs(rows)).collect()
    assert len(got) == len(rows)
    want = {i: x or "" for i, x in rows}
    for x in got:
        ids = t.encode(want[x.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(x.ids, "<u4").tolist() == ids and x.decoded == t.decode(ids, skip_special_tokens=False)


def test_licenses(docs):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace(",", " ;").replace("sublicense", "sub-licence")), (3, mit + " and more"), (4, None), (5, ""), (6, "!!!"), (7, "Released under the MIT License!")]
    got = {x.doc_id: x.license for x in licenses.scan(docs(rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "notice-MIT"}


def test_licenses_as_files_have_them(docs):
    """Titled, with copyright statements of several shapes, and wrapped so that a line starts with 'copyright'."""
    isc = licenses.KNOWN["ISC"].replace("above copyright", "above\ncopyright")
    mit = licenses.KNOWN["MIT"].replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")
    rows = [(1, "ISC License\n\nCopyright (c) 2020, Someone\n\n" + isc), (2, "MIT License\n\nCopyright © 2019-2021 A B\nAll rights reserved.\n\n" + mit), (3, isc), (4, "Copyright Jane Doe\n" + mit)]
    rows += [(5, "The MIT License (MIT)\n" + mit + "\nand more"), (6, "MIT License")]
    got = {x.doc_id: x.license for x in licenses.scan(docs(rows)).collect()}
    assert got == {1: "ISC", 2: "MIT", 3: "ISC", 4: "MIT", 5: None, 6: None}


def test_sharding(docs):
    rows = [(i, "x" * RNG.randrange(0, 3000)) for i in range(800)] + [(900, "y" * 50_000), (None, None)] + [(1000, "z" * 900)] * 300
    got = sharding.shard(docs(rows), limit=20_000).collect()
    shards = {}
    for x in got:
        shards.setdefault(x.shard, []).append(x)
    assert len(got) == len(rows)
    for name, own in shards.items():
        total = sum(x.n_bytes for x in own)
        assert (total <= 20_000 or len(own) == 1) and {(x.shard_bytes, x.shard_rows, x.depth) for x in own} == {(total, len(own), len(name))}
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))  # no shard lies in another
    assert sharding.shard(docs([])).count() == 0 and sharding.shard(docs(rows[:3]), 10**9).first().shard == ""


def test_sharding_loses_no_row_without_an_error(docs, monkeypatch):
    monkeypatch.setattr(sharding, "_bits", lambda prefix, hexed: "repeat('0', 32)")
    with pytest.raises(ValueError, match="agree in 64 bits"):
        sharding.shard(docs([(1, "x" * 60), (1, "y" * 60)]), limit=100)


def strip_repeats(rows, width=13):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(docs, texts):
    want = strip_repeats(texts)
    facts, removals = substring.repeated(docs([*texts, (None, prose(30))]))
    gone = {x.doc_id: x for x in removals.collect()}
    rows = [x for x in facts.collect() if x.doc_id is not None]
    assert len(rows) == len(texts)
    for x in rows:
        n, removed, kept = want[x.doc_id]
        assert x.n_words == n
        if x.copy:
            assert removed == n
        elif x.doc_id in gone:
            assert (gone[x.doc_id].removed, gone[x.doc_id].kept) == (removed, kept)
        else:
            assert removed == 0 and x.whole_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    facts, removals = substring.repeated(docs([]))
    assert facts.count() == 0 and removals.count() == 0


def test_fm_index_counts_and_matches():
    rng = random.Random(8)
    seqs = [[rng.randrange(1, 6) for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    index = substring.FMIndex(np.array([x for s in seqs for x in [*s, 0]], np.uint64))
    pattern = np.array([[rng.randrange(1, 7) for _ in range(4)] for _ in range(200)], np.uint64)
    low, high, length = index.search(pattern)
    count = lambda p: sum(s[i : i + len(p)] == p for s in seqs for i in range(len(s) - len(p) + 1))
    for row, a, b, n in zip(pattern.tolist(), low, high, length, strict=True):
        longest = max((k for k in range(5) if k == 0 or count(row[4 - k :])), default=0)
        assert n == longest and (n == 0 or b - a == count(row[4 - n :]))


def test_pipeline(spark, tmp_path):
    """Every stage against its input, judged by brute force; extra columns and awkward rows included."""
    import corpus_pipeline as p

    rng = random.Random(21)
    base, passage = prose(100, rng), prose(55, rng)
    texts = [base, edit(base, 2, rng), edit(base, 3, rng), *(prose(30, rng) + " " + passage + " " + prose(30, rng) for _ in range(4)), *(prose(50, rng) for _ in range(60)), None, "", "one"]
    texts += [prose(20, rng) + " zzvile zznasty. " + prose(20, rng) for _ in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash")).withColumn("rep", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int("zzvile" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        frame = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(frame.collect())
    clean = {i for i, t in enumerate(texts) if "zzvile" not in (t or "")}
    assert {x.doc_id for x in seen[0]} == clean
    sets = {x.doc_id: shingle_set(x.text) for x in seen[0]}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    first = components_of(sets, links)
    assert 1 not in {x.doc_id for x in seen[1]} == {i for i in clean if first[i] == i}
    want = strip_repeats([(x.doc_id, x.text) for x in seen[1]])
    before = {x.doc_id: x.text for x in seen[1]}
    for x in seen[2]:
        assert x.text == (want[x.doc_id][2] if want[x.doc_id][1] else before[x.doc_id])
    assert len(seen[2]) == len(seen[1]) and sum(want[x.doc_id][1] for x in seen[2]) >= 3 * 55
    assert {x.doc_id for x in seen[3]} <= {x.doc_id for x in seen[2]} and len(seen[4]) == len(seen[3])
    assert all(set(r[0].asDict()) == set(p.COLUMNS) for r in seen[:4])
    whole = {x.doc_id: x.text or "" for x in seen[2]}
    assert all(x.decoded_sha256 == hashlib.sha256(whole[x.doc_id].encode()).hexdigest() for x in seen[4])
    assert sorted((x.doc_id, x.ids_sha256) for x in p.run(spark, str(tmp_path)).collect()) == sorted((x.doc_id, x.ids_sha256) for x in seen[4])


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """Rows with a null or repeated doc_id: a toxic one, clean ones, near copies and a shared passage among them."""
    import corpus_pipeline as p

    rng = random.Random(31)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    bad = lambda: prose(20, rng) + " zzvile zznasty. " + prose(20, rng)
    rows = [(i, prose(50, rng) if i % 3 else bad()) for i in range(90)]
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean = [(i, prose(80, rng)) for i in (500, 500, 501, 501, None, None, None)]
    near = [(501, clean[2][1] + " x"), (None, clean[4][1]), (None, clean[0][1])]
    rows += clean + near + [(500, bad()), (None, bad())]
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], schema)
    kept = p.drop_toxic(spark, frame, str(tmp_path))
    got = sorted(x.text for x in kept.collect())
    assert got == sorted(t for _, t in rows if "zzvile" not in t)
    rest = p.drop_near_duplicates(spark, kept, str(tmp_path)).collect()
    assert sorted(x.text for x in rest if x.doc_id is None or x.doc_id >= 500) == sorted(t for _, t in clean)
    shared = [(7, prose(40, rng)), (8, prose(40, rng)), (8, prose(40, rng)), (None, prose(40, rng)), (None, prose(40, rng))]
    passage = shared[0][1]
    shared[2], shared[4] = (8, shared[2][1] + " " + passage), (None, shared[4][1] + " " + passage)
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in shared], schema)
    want = sorted(t.removesuffix(" " + passage) for _, t in shared)
    assert sorted(x.text for x in p.drop_repeated_passages(spark, frame, str(tmp_path)).collect()) == want


def test_penalty_is_chosen_without_held_out_labels(spark, docs):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, prose(25, rng) + (" grobword. " if bad else ". ") + prose(10, rng)))
        labels.append((i, int(bad)))
    schema = "doc_id long, toxic int"
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    pick = lambda y: toxicity.choose_penalty(docs(rows), spark.createDataFrame(y, schema), (0.5, 4.0)).collect()
    got = pick(labels)
    assert [x.l1 for x in got] == [0.5, 4.0] and all(np.isfinite(x.loss) and x.loss >= 0 for x in got)
    assert got == pick(other)
    assert pick([]) == []
