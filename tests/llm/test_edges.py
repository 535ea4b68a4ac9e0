"""Awkward input of each operator: empty tables, nulls, repeated rows and ids, very long texts, ties and clashing column names."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrivener.llm import ann, bpe, fingerprints, licenses, minhash, mixing, sharding, store, substring, text, toxicity, warc

RNG = random.Random(17)
CLASH = ("rep", "sign", "n_shingles", "bands", "key", "row", "rows", "rank", "size", "source_size", "target", "cell", "shard", "depth", "digest", "license", "copy", "n_bytes", "next_id", "own_id", "bins", "new", "leaf", "file_", "segments", "runs", "_source", "_i", "slice", "state", "mix_size", "ids", "decoded", "score")


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def clashing(df):
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


def test_extra_columns_do_not_matter(docs):
    rows = [(1, prose(30)), (2, prose(30)), (3, None), (None, "a b"), (2, "x")]
    table = docs([(i, t, s) for (i, t), s in zip(rows, "abcab", strict=True)])
    for run in (minhash.near_duplicates, fingerprints.edited, sharding.shard, licenses.scan, bpe.encode, lambda d: substring.repeated(d)[0], lambda d: toxicity.score(d, (np.zeros(1 << toxicity.FEATURE_BITS, np.float32), -3.0))):
        assert sorted(map(str, run(table).collect())) == sorted(map(str, run(clashing(table)).collect()))
    mixed = mixing.mix(clashing(table))
    assert set(mixed.columns) == {*table.columns, *CLASH, "mix_size", "mix_source_size", "mix_target", "mix_times"} and mixed.where("rows <> 7 or state <> 7").count() == 0
    assert sorted(x.mix_times for x in mixed.collect()) == sorted(x.mix_times for x in mixing.mix(table).collect())


def test_fingerprints_of_nulls_and_repeated_ids(docs):
    rows = [(5, "one two three four five six"), (5, "zzz other words are here now"), (3, "é" * 11), (None, "null id"), (4, None), (4, None)]
    got = fingerprints.edited(docs(rows)).collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # 5 is followed by 4 (null, so empty), 4 by 3, 3 by null, null by 5, whose smallest text stands for it
    want = sorted([(5, digest(rows[0][1][:14])), (5, digest(rows[1][1][:14])), (3, digest("é" * 6 + "null ")), (4, digest("")), (4, digest("")), (-1, digest("null" + "one"))])
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.edited_sha256) for x in got) == want
    marked = fingerprints.fingerprint(docs(rows)).collect()
    assert {(x.text, x.fingerprint) for x in marked} == {(t, f) for t, f in ((x.text, x.fingerprint) for x in marked)} and len({x.fingerprint for x in marked if x.text}) == 4
    assert {x.fingerprint for x in marked if x.text is None} == {""}


def test_nearest_with_few_candidates(spark):
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], schema)
    got = [(x.query_id, x["rank"], x.vec_id) for x in ann.search(table, table.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]
    assert ann.search(table.where("vec_id = 0"), table.where("vec_id = 0")).count() == 0


def test_toxicity_of_repeated_rows(spark, docs):
    rows = [(i, prose(12) + (" vileword. " if i % 3 == 0 else ". ") + prose(6)) for i in range(120)]
    rows += rows[:30]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(0, 1), (1, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs(rows), toxicity.train(docs(rows), labels)).collect()
    by_id = {}
    for x in got:
        assert by_id.setdefault(x.doc_id, (x.score, x.predicted)) == (x.score, x.predicted)
    assert len(got) == 150 and sum(p != (i % 3 == 0) for i, (_, p) in by_id.items()) <= 3


def test_toxicity_learns_from_bounded_bytes(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    batches = docs([(i, "x" * 900) for i in range(9)]).select("text", F.lit(1).alias("y")).toArrow().to_batches()
    seen = []
    monkeypatch.setattr(toxicity, "blocks", lambda column: ((i, i + 1, np.frombuffer(b"x" * 900, np.uint8), np.array([0, 900])) for i in range(len(column))))
    _, _, _, label = toxicity._bags(iter(batches), None)
    assert len(label) == 2 and not seen


def test_toxicity_fit_in_chunks_is_the_fit_in_one_and_stays_small(monkeypatch):
    draw = np.random.default_rng(5)
    n, docs = 1 << 21, 4000
    sentence = np.sort(draw.integers(0, n // 8, n)).astype(np.int32)
    feature = draw.integers(0, 3000, n).astype(np.int32)
    doc, label = np.sort(draw.integers(0, docs, n // 8)).astype(np.int32), (draw.random(docs) < 0.4).astype(np.int32)
    feature[(label[doc[sentence]] > 0) & (draw.random(n) < 0.02)] = 7
    monkeypatch.setattr(toxicity, "STEPS", 3)
    few = slice(0, 30000)
    whole = toxicity.fit(sentence[few], feature[few], doc, label)
    monkeypatch.setattr(toxicity, "CHUNK", 64, raising=False)
    cut = toxicity.fit(sentence[few], feature[few], doc, label)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1] and whole[0].any()
    monkeypatch.undo()
    monkeypatch.setattr(toxicity, "STEPS", 3)
    tracemalloc.start()
    try:
        toxicity.fit(sentence, feature, doc, label)
        assert tracemalloc.get_traced_memory()[1] < 28 * n  # bytes a word, beside the arguments
    finally:
        tracemalloc.stop()


def test_workers_give_back_what_they_freed(monkeypatch):
    seen = []
    monkeypatch.setattr(text, "trim", lambda: seen.append("trim"))

    def run(batches):
        for batch in batches:
            seen.append(batch)
            yield batch

    assert list(text.trimmed(run)(iter("ab"))) == ["a", "b"] and seen == ["a", "trim", "b", "trim", "trim"]
    assert text.trimmed(lambda frame: frame + 1)(1) == 2 and len(seen) == 6
    with pytest.raises(ZeroDivisionError):
        text.trimmed(lambda frame: frame / 0)(1)
    assert len(seen) == 7


def test_bpe_results_do_not_hold_the_batch():
    table = pa.table({"doc_id": range(300), "text": [prose(400) for _ in range(300)]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    whole = sink.getvalue()
    got = list(bpe._encode(bpe.default_vocabulary())(iter(pa.ipc.open_stream(whole))))
    assert sum(x.num_rows for x in got) == 300
    ids = got[0].column(0).buffers()[1]
    assert not whole.address <= ids.address < whole.address + whole.size


def test_bpe_keeps_no_pieces_after_a_task():
    path = bpe.default_vocabulary()
    batch = pa.record_batch({"doc_id": [1, 2], "text": [prose(300), "<|endoftext|> a b"]})
    first = list(bpe._encode(path)(iter([batch, batch])))
    kept = bpe.vocabulary(path)
    assert kept.known == kept.special and all(x.equals(first[0]) for x in first)
    begun = bpe._encode(path)(iter([batch, batch]))
    assert next(begun).equals(first[0]) and len(kept.known) > len(kept.special)
    begun.close()  # a task that is stopped, too
    assert kept.known == kept.special


def test_small_tables_start_no_python_workers(spark, docs):
    rows = [(1, "a b", "x"), (2, "c", None), (3, "d e f", "y")]
    table = mixing.targets(docs(rows).groupBy("source").agg(F.sum("n_chars").alias("source_size")))
    assert table.dtypes == [("source", "string"), ("source_size", "bigint"), ("target", "double")]
    none = mixing.targets(docs([]).groupBy("source").agg(F.sum("n_chars").alias("source_size")))
    assert {x.source for x in table.collect()} == {"x", None, "y"} and none.dtypes == table.dtypes and none.count() == 0
    kept = store.cut(docs(rows))
    ranks = store.ranked(kept, F.col("doc_id").desc())
    assert [x.doc_id for x in ranks.orderBy("rank").collect()] == [3, 2, 1] and dict(ranks.dtypes)["rank"] == "bigint"
    for made in (table, none, ranks, store.ranked(kept.limit(0), F.col("doc_id"))):
        made.collect()
        assert "RDD" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_dealt_entries_are_whole(docs):
    batch = docs([(i, prose(60)) for i in range(40)] + [(50, "")]).select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    entries = np.sort(substring._entries(batch, 13))
    (dealt,) = substring._deal(13, 1000)(iter([batch]))
    dealt.validate(full=True)
    parts = [np.frombuffer(x, substring._ENTRY) for x in dealt.column(1).to_pylist()]
    assert all(len(p) and ((p["anchor"] >> np.uint64(20)) % np.uint64(1000) == n).all() for n, p in zip(dealt.column(0).to_pylist(), parts, strict=True))
    assert (np.sort(np.concatenate(parts)) == entries).all()


def test_warc_of_a_very_long_record(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "é" * 1_000_000), (3, None, None)], "page_id long, url string, html string")
    broken = pages.withColumn("html", F.when(F.col("page_id") == 2, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    got = {x.page_id: x for x in warc.audit(clashing(pages), broken).collect()}
    assert {i for i, x in got.items() if not x.intact} == {2} and got[1].n_bytes > 3_000_000 and got[2].offset == got[1].n_bytes and got[2].n_bytes > 2_000_000


def test_warc_files_longer_than_usual(spark):
    rows = [(i, "u", str(i), 0, 1000 * i) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file long, offset long")
    got = warc.audit(pages, pages.where("page_id <> 1400")).collect()
    assert len(got) == 1500 and {x.page_id for x in got if not x.intact} == {1400} and len({x.root for x in got}) == 1


def test_bpe_of_nothing_nulls_and_repeated_rows(docs):
    assert bpe.digests(bpe.encode(docs([]))).count() == 0
    got = bpe.digests(bpe.encode(docs([(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "")]))).collect()
    assert sorted((str(x.doc_id), x.n_tokens) for x in got) == [("1", 2), ("1", 2), ("2", 0), ("3", 0), ("None", 2)]
    assert len({x.ids_sha256 for x in got}) == 2 and len({x.decoded_sha256 for x in got}) == 2


def test_licenses_given_by_the_caller(spark, docs):
    own = spark.createDataFrame([("B", "Do as you like."), ("A", "do AS you like"), ("C", ""), ("D", None)], "license string, text string")
    rows = [(1, "Do as you like!"), (1, "Do as you like!"), (2, "do as you like " * 40_000), (None, "DO AS YOU LIKE"), (3, licenses.KNOWN["MIT"])]
    got = licenses.scan(docs(rows), own).collect()
    assert sorted((str(x.doc_id), x.license) for x in got if x.license) == [("1", "A"), ("1", "A"), ("None", "A")] and len(got) == 5
    assert licenses.scan(docs([])).count() == 0


def test_licenses_of_whole_files(docs):
    names = {"BSD-2-Clause": ("BSD 2-Clause License\n\nCopyright (c) 2024, A. Author\n\n", ""), "BSD-3-Clause": ("", ""), "Unlicense": ("", ""), "Zlib": ("zlib License\n\n(C) 2020 X\n\n", "\n")}
    rows = [(i, names[n][0] + licenses.KNOWN[n].replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ") + names[n][1]) for i, n in enumerate(names)]
    got = {x.doc_id: x.license for x in licenses.scan(docs(rows)).collect()}
    assert got == dict(enumerate(names))
    assert len(set(licenses.DIGESTS.values())) == len(licenses.DIGESTS)
    words = licenses.scan(docs([(1, "grub license"), (2, "grublicense"), (3, "sub-licence"), (4, "sublicense")])).collect()
    by_id = {x.doc_id: x.digest for x in words}
    assert by_id[1] != by_id[2] and by_id[3] == by_id[4]


@pytest.mark.skipif(not __import__("os").path.isdir("/usr/share/common-licenses"), reason="no licence files here")
def test_licenses_kept_as_digests(docs):
    read = lambda f: open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()  # noqa: E731, SIM115
    got = {x.doc_id: x.license for x in licenses.scan(docs([(1, read("Apache-2.0")), (2, read("GPL-3").replace("\n", "\r\n")), (3, read("MPL-2.0").upper()), (4, read("GPL-3")[:-9000])])).collect()}
    assert got == {1: "Apache-2.0", 2: "GPL-3.0", 3: "MPL-2.0", 4: None}


def test_shards_do_not_depend_on_how_the_table_lies(docs, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 50)
    rows = [(i, "x" * RNG.randrange(0, 900)) for i in range(300)] + [(7, "same")] * 400 + [(7, prose(40, random.Random(i % 60))) for i in range(300)] + [(None, None)] * 30
    flat = lambda d: sorted(map(str, sharding.shard(d, limit=5_000).collect()))
    table = docs(rows)
    got = flat(table.repartition(3))
    assert got == flat(table.repartition(5)) == flat(table.orderBy(F.desc("text"))) and len(got) == len(rows)
    sizes = {}
    for x in sharding.shard(table, limit=5_000).collect():
        sizes.setdefault(x.shard, []).append(x)
    assert all(sum(x.n_bytes for x in own) <= 5_000 or len(own) == 1 for own in sizes.values())
    assert all((x.shard_bytes, x.shard_rows, x.depth) == (sum(y.n_bytes for y in own), len(own), len(name)) for name, own in sizes.items() for x in own)


def test_only_oversized_buckets_split(docs):
    rows = [(i, "x" * RNG.randrange(0, 900)) for i in range(500)]
    got = sharding.shard(docs(rows), limit=4_000).collect()
    held = {}
    for x in got:
        for k in range(x.depth):
            held[x.shard[:k]] = held.get(x.shard[:k], 0) + x.n_bytes
    assert all(n > 4_000 for n in held.values())  # whatever was split was too large


def strip_repeats(rows, width=13):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = t.split(" ")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [0, 3, 1 << 12])
def test_substring_dedup_with_hot_anchors(docs, monkeypatch, hot):
    """A line that half of the documents hold between different words, a passage and near copies; anchors cut into windows or not."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "PART_BYTES", 1 << 10)
    rng = random.Random(2)
    line, passage, base = prose(9, rng), prose(40, rng), prose(70, rng)
    rows = [(i, " ".join([prose(15, rng), line, prose(15, rng)])) for i in range(60)] + [(100 + i, " ".join([prose(6, rng), passage, prose(9, rng)])) for i in range(20)]
    rows += [(200 + i, base.replace(base.split(" ")[i], "zz")) for i in range(40)] + [(300, line), (301, passage), (302, base), (303, base), (304, rows[0][1] + " " + rows[1][1])]
    want = strip_repeats(rows)
    facts, removals = substring.repeated(docs(rows).repartition(6))
    gone = {x.doc_id: (x.removed, x.kept) for x in removals.collect()}
    for x in facts.collect():
        n, removed, kept = want[x.doc_id]
        assert x.n_words == n and ((removed == n) if x.copy else gone.get(x.doc_id, (0, kept)) == (removed, kept)), x.doc_id


def test_matching_statistics_against_the_rest_of_an_index():
    rng = random.Random(4)
    seqs = [[rng.randrange(1, 4) for _ in range(rng.randrange(4, 30))] for _ in range(25)]
    index = substring.FMIndex(np.array([x for s in seqs for x in [*s, 0]], np.uint64), width=4)
    assert not hasattr(index, "suffix") and len(index.owner) == sum(max(0, len(s) - 3) for s in seqs)
    windows = [(k, i, s[i : i + 6]) for k, s in enumerate(seqs) for i in range(len(s) - 5)]
    low, high, length = index.search(np.array([w for *_, w in windows], np.uint64), least=2)
    count = lambda p: sum(s[i : i + len(p)] == p for s in seqs for i in range(len(s) - len(p) + 1))
    holds = lambda p: [k for k, s in enumerate(seqs) if any(s[i : i + len(p)] == p for i in range(len(s) - len(p) + 1))]
    value = np.array([rng.randrange(1000) for _ in seqs], np.int64)
    for (_, _, w), a, b, n in zip(windows, low, high, length, strict=True):
        assert n == max((m for m in range(1, 7) if count(w[6 - m :]) > 1), default=0) and (n == 0 or b - a == count(w[6 - n :]))
    full = length == 6
    least = index.least(low[full], high[full], value)
    assert [int(x) for x in least] == [int(value[holds(w)].min()) for (_, _, w), f in zip(windows, full, strict=True) if f]


def test_settled_tables(docs, tmp_path, spark):
    docs([(1, "a")]).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plain = table.where("doc_id > 0").select("doc_id")
    assert store.settled(plain) is plain
    dealt = table.repartition(3)
    assert store.settled(dealt) is not dealt and store.settled(dealt).count() == 1


def test_operators_leave_only_their_results(docs, spark):
    import os

    here = store.folder(spark).removeprefix("file://")
    before = set(os.listdir(here))
    rows = docs([(i, prose(30)) for i in range(20)] + [(30, "a b c d e f g"), (31, "a b c d e f g")])
    kept = minhash.near_duplicates(rows)
    assert len(set(os.listdir(here)) - before) == 1 and kept.where("not kept").count() == 1
    before = set(os.listdir(here))
    facts, removals = substring.repeated(rows)
    assert len(set(os.listdir(here)) - before) == 2 and facts.count() == 22 and removals.count() == 0


def test_substring_dedup_holds_the_shuffle_files_of_one_step(docs, spark, monkeypatch):
    """When a step is written, the files of those before are gone; no step shuffles the index's words beside what is joined later."""
    import glob
    import time

    own = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in own for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, left, plans = files(), [], []

    def gone():
        end = time.time() + 5
        while (new := files() - before) and time.time() < end:
            time.sleep(0.05)
        return new

    def watched(df, cut=substring.cut):
        left.append(gone())
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(substring, "cut", watched)
    passage = prose(30)
    rows = [(i, f"{prose(5)} {passage} {prose(4)}") for i in range(20)]
    setting = spark.conf.get(name := "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    _, removals = substring.repeated(docs(rows))
    assert len(left) > 4 and not any(left) and not gone()
    assert not any("FlatMapGroupsInPandas" in p and "Join" in p for p in plans)
    assert sorted((x.doc_id, x.removed) for x in removals.collect()) == [(i, 30) for i in range(1, 20)]
    assert spark.conf.get(name, None) == setting


def test_a_cluster_has_to_name_its_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.folder(Session)
    Session.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.folder(Session)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
