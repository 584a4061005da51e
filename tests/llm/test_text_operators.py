import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import text_brute as brute
from pyspark.sql import functions as F

from kithgraph.llm import chat, common, dedup_exact, jaccard, language, mixing, packing, queries, token_counts, toxicity
from kithgraph.llm.common import components


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def duck(data, text):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con.sql(text).df()


def lines(frame):
    return sorted(tuple(str(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, data, name):
    got, expect = queries.QUERIES[name](spark, data).toPandas(), duck(data, queries.SQL[name])
    assert sorted(got.columns) == sorted(expect.columns) and lines(got) == lines(expect)


# ---------------------------------------------------------------- exact dedup


def expected_groups(rows):
    by = defaultdict(list)
    for place, (i, t) in enumerate(rows):
        by[brute.SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, place))
    return by


def test_exact_groups_on_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    by = expected_groups(rows)
    got = dedup_exact.exact_groups(edge_docs).collect()
    assert len(got) == len(rows)
    for r in got:
        (key,) = {k for k, g in by.items() if any((i == r["doc_id"] if not none else r["doc_id"] is None) for _, none, i, _ in g)}
        best = min(by[key])
        assert r["group_size"] == len(by[key]) and r["keep_id"] == (None if best[1] else best[2])
    assert sum(r["kept"] for r in got) == len(by)
    assert dedup_exact.exact_groups(no_docs).count() == 0 and dedup_exact.deduplicated(no_docs).count() == 0
    kept = dedup_exact.deduplicated(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(by)


def test_full_bytes_are_compared_on_hits(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)]
    weak = dedup_exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda c: F.substring(dedup_exact.sha256(c), 1, 0))
    by = expected_groups(rows)
    keep = {min(g)[2] for g in by.values()}
    assert {r["doc_id"] for r in weak.filter("kept").collect()} == keep
    assert {r["group_size"] for r in weak.collect()} == {len(g) for g in by.values()}


def test_several_triggers_agree_with_one(docs):
    many = dedup_exact.exact_groups(docs.repartition(5), files_per_trigger=1).drop("locator")
    assert many.exceptAll(dedup_exact.exact_groups(docs).drop("locator")).isEmpty()


def loaded_stores(spark) -> int:
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    (held,) = (f for f in kind.getDeclaredFields() if f.getName().endswith("loadedProviders"))
    held.setAccessible(True)
    return held.get(kind.getField("MODULE$").get(None)).size()


def test_state_stores_close_with_their_tasks(spark, docs):
    before = loaded_stores(spark)
    assert dedup_exact.exact_groups(docs).count() == docs.count()
    assert loaded_stores(spark) <= before


def test_tasks_give_memory_back(monkeypatch):
    ends = []
    monkeypatch.setattr(common, "give_back", lambda: ends.append(1))
    run = common.lean(lambda batches: (x + 1 for x in batches))
    assert list(run([1, 2])) == [2, 3] and ends == [1]
    part = run([1, 2])  # a limit above ends a task early
    next(part)
    part.close()
    assert ends == [1, 1]


def test_state_outlives_a_run(spark, docs, tmp_path):
    halves = [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").repartition(3).unionAll(docs.filter("doc_id = 1"))]
    state, columns = f"file://{tmp_path}/state", ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    for half in halves:
        last = dedup_exact.exact_groups(half, state=state).select(columns).collect()
    whole = dedup_exact.exact_groups(docs.unionAll(docs.filter("doc_id = 1"))).select(columns).collect()
    assert sorted(map(str, dedup_exact.held_groups(spark, state).select(columns).collect())) == sorted(map(str, whole))
    assert sorted(map(str, last)) == sorted(str(r) for r in whole if r["doc_id"] % 2 == 1)
    assert dedup_exact.exact_groups(halves[0].limit(0), state=state).count() == 0


def test_bytes_are_compared_with_earlier_runs(spark, tmp_path):
    weak = lambda c: F.substring(dedup_exact.sha256(c), 1, 0)
    rows = [(i, f"text {i % 5}") for i in range(20)]
    for part in (rows[:9], rows[9:]):
        got = dedup_exact.exact_groups(spark.createDataFrame(part, "doc_id long, text string"), digest=weak, state=f"file://{tmp_path}/state").collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, i % 5, 4) for i in range(9, 20)}


def test_locators_find_rows_and_stay(docs):
    got = {r["doc_id"]: r["locator"] for r in dedup_exact.exact_groups(docs).collect()}
    there = {(r["f"], r["p"]): r["doc_id"] for r in docs.selectExpr("doc_id", "_metadata.file_path f", "_metadata.row_index p").collect()}
    assert all(there[v["file"], v["position"]] == i for i, v in got.items())


def test_rows_without_a_place_get_one(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.json(f"{tmp_path}/json")
    text = spark.read.schema("doc_id long, text string").json(f"{tmp_path}/json")
    assert dedup_exact.plain_scan(docs.filter("doc_id > 3")) and not dedup_exact.plain_scan(text) and not dedup_exact.plain_scan(docs.union(docs))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, dedup_exact.exact_groups(text).select(columns).collect())) == sorted(map(str, dedup_exact.exact_groups(docs).select(columns).collect()))


# ---------------------------------------------------------------- Jaccard


def near_docs(spark, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 2000, n)]
    out = []
    for n, copies, most in ((40, 30, 1), (60, 60, 2), (100, 60, 4), (200, 60, 8)):
        base = draw(n)
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.integers(0, most + 1)):
                x[rng.integers(0, n)] = vocabulary[rng.integers(0, 2000)]
            out.append(" ".join(x if rng.random() < 0.7 else x[: rng.integers(n // 2, n)]))
    passage = draw(60)
    out += [" ".join(passage + draw(rng.integers(1, 40))) for _ in range(40)]
    out += [" ".join(draw(rng.integers(0, 30))) for _ in range(60)]
    out += ["Hello World", "hello\tworld", "", None, " \n", out[0].upper()]
    order = rng.permutation(len(out))
    rows = [(int(i), out[k]) for i, k in enumerate(order)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_against_all_pairs(spark):
    rows, frame = near_docs(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(frame).collect()}
    assert got == brute.jaccard_components(rows)


@pytest.mark.parametrize(("short", "leaders", "seed"), [(1, 1, 6), (1, 2, 7), (4, 1, 8)])
def test_jaccard_with_long_lists_only(spark, monkeypatch, short, leaders, seed):
    rows, frame = near_docs(spark, seed)
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(frame).collect()}
    assert got == brute.jaccard_components(rows)


def changed_copies(copies=700, words=150, seed=4):
    """A large group: copies of one text, each changed at places of its own, of which many end just out of reach of all others."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    rows = []
    for i in range(copies):
        x = list(base)
        for k, at in enumerate(rng.choice(words, rng.integers(1, 6), replace=False)):
            x[at] = f"own{i}x{k}"
        rows.append((i, " ".join(x)))
    return rows


def test_jaccard_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    rows, made, screen = changed_copies(), [], jaccard.Links.screen

    def counted(self, pairs):
        made.append(pairs.select("a", "b").distinct().count())
        return screen(self, pairs)

    monkeypatch.setattr(jaccard.Links, "screen", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expect = brute.jaccard_components(rows)
    assert got == expect and len({c for _, c in expect.values()}) > 50  # a large group and many texts near it
    assert sum(made) < 20 * len(rows)


@pytest.mark.parametrize(("middle", "seed"), [(0, 9), (8, 10)])
def test_jaccard_with_and_without_pivots(spark, monkeypatch, middle, seed):
    rows, frame = near_docs(spark, seed)
    monkeypatch.setattr(jaccard, "SHORT", 1)
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "MIDDLE", middle)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(frame).collect()}
    assert got == brute.jaccard_components(rows)


def shared_passages(texts=60, of=10, taken=6, words=40, seed=5):
    """Texts of the same few passages in orders of their own: all their lists are long, few of them are near another."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{i}w{j}" for j in range(words)) for i in range(of)]
    return [(i, " ".join(passages[k] for k in rng.choice(of, taken, replace=False))) for i in range(texts)]


def test_jaccard_of_shared_passages_writes_little(spark, monkeypatch):
    rows, written, plain = shared_passages(), defaultdict(int), jaccard.stored

    def counted(df, tag, share=1):
        out = plain(df, tag, share)
        written[tag] += out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(rows)
    assert written["differences"] < 10 * len(rows)  # not what each text differs in from one that is not near


def test_jaccard_leaves_no_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}

    rows, frame = near_docs(spark, 11)
    before = files()
    jaccard.jaccard_groups(frame)
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before


def test_sketch_grows_with_the_texts(spark, monkeypatch):
    rows, frame = near_docs(spark, 12)
    texts = frame.select("text")
    monkeypatch.setattr(jaccard, "LEAST_BITS", 16)
    few = jaccard.count_sketch(texts, 5)
    monkeypatch.setattr(jaccard, "CELL_BYTES", 0.01)
    monkeypatch.setattr(jaccard, "HELD", 500)
    many = jaccard.count_sketch(texts, 5)
    size = sum(len((t or "").encode()) for _, t in rows)
    assert len(few) == 1 << 16 and len(many) == 1 << int(np.ceil(np.log2(size / 0.01)))
    true = defaultdict(int)
    for _, h in jaccard.sets(pa.array([t for _, t in rows], pa.string())):
        for x in h:
            true[int(x)] += 1
    h = np.array(list(true), np.uint64)
    for rank in (few, many):
        cells = np.bincount((h >> np.uint64(65 - len(rank).bit_length())).astype(np.int64), list(true.values()), len(rank))
        assert (rank == (jaccard.STEPS * np.log2(1.0 + cells)).astype(np.uint16)).all()


def test_gaps_of_cells():
    rng = np.random.default_rng(0)
    for cells in ([0], [65535], [255, 510, 511], [7] * 1000 + [9], rng.integers(0, 65536, 500), rng.integers(0, 300, 5000)):
        cells = np.sort(np.asarray(cells, np.int64))
        assert (jaccard.cells_of(jaccard.gaps(cells)) == cells).all()


def test_filter_of_needed_sets_grows(spark, monkeypatch):
    rows = [(i, f"text {i} of its own with words {i * 7} and {i * 11} so that no other is near it") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.selectExpr("doc_id as node", "doc_id")
    monkeypatch.setattr(jaccard, "LEAST_FILTER", 15)
    held = []
    for share in (1000, 10):
        check = jaccard.Links(nodes, docs, 5, 80)
        check.hold(nodes.filter(f"node < {share}").select("node"))
        held.append(check.sets.count())
        check.forget()
    assert 1000 <= held[0] < 1250 and 10 <= held[1] < 20


def test_distinct_documents_with_repeated_identifiers(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (1, b), (2, a), (1, a), (None, b), (None, "alone in the whole wide world"), (3, None), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kg_id", "1 as gone_id", "2 as mark", "3 as first")
    kept = jaccard.distinct_documents(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in [(1, a), (1, b), (None, rows[5][1]), (3, None), (3, None)])


def test_jaccard_on_edges(edge_docs, no_docs):
    got = jaccard.jaccard_groups(edge_docs).collect()
    assert len(got) == 13 and jaccard.jaccard_groups(no_docs).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(8, 1)] and by[2] == [(8, 1)] and by[3] == [(0, 3)] and by[5] == [(0, 5)] and by[7][0][1] == 6 and by[8] == [by[8][0]] * 2 and by[11] == [(1, 11)]
    kept = jaccard.distinct_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9, 10, 11]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i % 313}" for i in range(3000))
    whole = dict(jaccard.sets(pa.array([text, "a b"])))
    monkeypatch.setattr(jaccard, "CHUNK", 1000)
    parts = dict(jaccard.sets(pa.array([text, "a b"])))
    assert all((whole[i] == parts[i]).all() for i in (0, 1)) and len(whole[0]) == len(brute.shingle_set(text))


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500, i) for i in range(501, 540)] + [(i, i + 1) for i in range(600, 640)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expect = brute.components({x for e in links for x in e}, links)
    assert got == {k: v for k, v in expect.items() if k in got} and all(k in got for e in links if e[0] != e[1] for k in e)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- tokens and packing


def test_token_counts(edge_docs, no_docs, docs, texts):
    path = queries.vocabulary("word_bpe_49k.json")
    tok = token_counts.tokenizer(path)
    got = token_counts.count_tokens(docs, path).collect()
    for r in got:
        t = texts[r["doc_id"]]["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    edge = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(edge_docs, path).collect())
    assert edge == Counter((r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in edge_docs.collect())
    assert token_counts.count_tokens(no_docs, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_odd_texts(spark, name):
    path = queries.vocabulary(name)
    odd = ["a<|endoftext|>b <|startoftext|>c", "ΣΑΣ ΟΔΟΣ x", "é  ́x İstanbul", "it's\x1fdon't I'LL\x85 y", "a b　c", "\x0b\x0c q\r\n", "x" * 5000 + " " + "9" * 300, "don 't", " lead", "trail "]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path).collect()}
    tok = token_counts.tokenizer(path)
    assert [got[i] for i in range(len(odd))] == [len(tok.encode(t)) if name.endswith(".model") else len(tok.encode(t, add_special_tokens=False).ids) for t in odd]


def check_packing(rows, tok, frame):
    expect = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k in range(len(cuts) - 1):
            expect[i, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(ids[cuts[k] : cuts[k + 1]].tobytes())] += 1
    got = frame.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expect
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by), sum(r["length"] for r in got)


def test_packing(docs, texts, edge_docs, no_docs):
    path = queries.vocabulary("byte_bpe_50k.json")
    tok = token_counts.tokenizer(path)
    used, total = check_packing([(i, r["text"]) for i, r in texts.items()], tok, packing.pack(docs, path))
    assert used <= -(-total // 1024) + 3
    check_packing([(r["doc_id"], r["text"]) for r in edge_docs.collect()], tok, packing.pack(edge_docs, path))
    assert packing.pack(no_docs, path).count() == 0


def test_quick_encoder_agrees_with_library(texts):
    path = queries.vocabulary("byte_bpe_50k.json")
    encode = packing.Encoder(path)
    odd = [r["text"] or "" for r in texts.values()] + ["a<|endoftext|>b", "  x\n\n y", "it's   x  ", "日本語", "  ", "naïve Ünïcode — dash", "\t\ttab", "x\r\ny", "Ǆ ǅ ⅷ ² ½"]
    assert all(list(x) == y.ids for x, y in zip(encode(odd), encode.tok.encode_batch(odd, add_special_tokens=False), strict=True))


@pytest.mark.parametrize("kind", ["uniform", "small", "large", "one"])
def test_packing_plans_hold_every_length(kind):
    rng = np.random.default_rng(4)
    draws = {"uniform": rng.integers(1, 1025, 5000), "small": rng.integers(1, 60, 5000), "large": rng.integers(600, 1025, 2000), "one": np.full(77, 300)}[kind]
    counts = np.bincount(draws, minlength=1025)
    plan = packing.plan_sequences(counts, 1024)
    held = np.zeros(1025, int)
    for lengths, times in plan:
        assert sum(lengths) <= 1024 and times > 0
        for v in lengths:
            held[v] += times
    assert (held == counts).all()
    # as few as by best fit alone, which is near the least there can be
    used, plain = sum(t for _, t in plan), sum(t for _, t in packing.best_fit(counts.copy(), 1024))
    assert used <= plain + 2 and used >= -(-int(draws.sum()) // 1024)


def test_fitted_patterns_hold_most_sequences():
    draws = np.clip(np.random.default_rng(3).lognormal(5.5, 0.9, 20_000).astype(int), 1, 1023)
    counts = np.bincount(draws, minlength=1025)
    pats = packing.patterns(1024, np.flatnonzero(counts))
    x = packing.fit_repeats(pats, counts.astype(float))
    least = -(-int(draws.sum()) // 1024)
    for share in packing.SHARES:
        plan, left = packing.rounded(pats, x, counts, share)
        held = sum(t for _, t in plan)
        assert held >= 0.5 * least and (left >= 0).all() and all(sum(p) == 1024 for p, _ in plan)
    assert sum(t for _, t in packing.plan_sequences(counts, 1024)) <= least + 2


# ---------------------------------------------------------------- mixing


def check_mix(rows, got, weights=(3.0, 1.0, 2.0)):
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(brute.words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [weights[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2.0), strict=True))
    taken, left = defaultdict(int), defaultdict(list)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["taken"]
        if sizes[r["source"]] and r["copies"] == int(target[r["source"]] // sizes[r["source"]]):
            left[r["source"]].append(r["size"])
    for s in order:  # within the smallest document left out of the last pass
        assert -1e-6 <= target[s] - taken[s] <= max(min(left[s], default=0), 1e-6)


def test_mixing(docs, texts, edge_docs, no_docs):
    got = mixing.mix_plan(docs).collect()
    check_mix([(i, r["text"], r["source"]) for i, r in texts.items()], got)
    again = mixing.mix_plan(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    edge = mixing.mix_plan(edge_docs).collect()
    assert len(edge) == 13 and mixing.mix_plan(no_docs).count() == 0 and mixing.mixed(edge_docs).columns == edge_docs.columns


def test_shards_are_partitions(spark, docs, tmp_path):
    got = mixing.mix_plan(docs, shards=6, block_docs=8).collect()
    mixing.mixed(docs, shards=6, block_docs=8).write.parquet(f"{tmp_path}/mix")
    files = defaultdict(Counter)
    for r in spark.read.parquet(f"{tmp_path}/mix").selectExpr("doc_id", "_metadata.file_name f").collect():
        files[r["f"]][r["doc_id"]] += 1
    expect = defaultdict(Counter)
    for r in got:
        for k in r["shards"]:
            expect[k][r["doc_id"]] += 1
    assert sorted(map(sorted, (c.items() for c in files.values()))) == sorted(map(sorted, (c.items() for c in expect.values())))
    units = [sum(c.values()) for c in expect.values()]
    assert len(units) == 6 and max(units) - min(units) < 0.5 * max(units)


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c d", "s")] * 700 + [(None, "e f", "s")] * 90 + [(i, "g " * (i % 9), "t") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(frame, block_docs=64).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r["source"], r["target"]] += r["taken"]
    assert len(got) == len(rows) and all(0 <= target - words < 9 for (_, target), words in taken.items())
    assert Counter(r["doc_id"] for r in mixing.mixed(frame, block_docs=64).collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter())


def test_shard_counts_follow_the_size():
    assert [mixing.shard_count(x) for x in (0, 1e6, 1e9, 1e12, 1.5e13)] == [1, 1, 239, 7451, 111759]


def test_water_fill():
    assert mixing.water_fill([10, 100, 100], [3, 1, 2], 315, 2) == pytest.approx([20, 98.333333333, 196.666666667])
    assert mixing.water_fill([10, 0], [3, 1], 100, 2) == [20, 0.0] and mixing.water_fill([], [], 0, 2) == []


def test_splitting_tree():
    quotas = [1000, 10, 0, 333]
    tree = mixing.splitting_tree(quotas, 7, 1)
    assert tree.sum(axis=0).tolist() == quotas and (tree >= 0).all()
    assert max(tree.sum(axis=1)) - min(tree.sum(axis=1)) <= 3
    draws = np.array([mixing.splitting_tree([60, 40], 2, s)[0, 0] for s in range(3000)])
    assert abs(draws.mean() - 30) < 0.3 and abs(draws.var() - 60 * 40 / 100 / 4 * 100 / 99) < 0.8


# ---------------------------------------------------------------- language and toxicity


def test_language(docs, texts, edge_docs, no_docs):
    model = language.fit(docs.filter(queries.fold(4) != 2))
    got = language.predict(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in held)
    assert len(held) > 20 and right >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: r for r in language.predict(edge_docs, model).collect()}
    assert [edge[i]["lang_pred"] for i in (3, 4, 5, 10)] == ["und"] * 4 and edge[3]["score"] == 0.0 and edge[9]["lang_pred"] != "und"
    assert language.predict(no_docs, model).count() == 0
    none = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.predict(edge_docs, none).collect()} == {"und"}
    assert language.predict(edge_docs, model, keep="told").columns == [*edge_docs.columns, "told"]


def test_marks_are_no_letters():
    import pyarrow as pa

    model = language.Model([("aa", "kato", 5)], {"aa": 5})
    langs, score = model.predict(pa.array(["\u0301", "1 \u0301 2", "e\u0301", "kato \u0301"], pa.large_string()))
    assert langs == ["und", "und", "aa", "aa"] and score[0] == score[1] == 0


def plain_language(rows, texts):
    """Word-first backoff in plain Python: rows (language, text) to learn from, then the language of each text."""
    import math
    import unicodedata

    letter = lambda c: unicodedata.category(c)[0] in "LM"
    words = lambda t: [w for w in "".join(c if letter(c) else " " for c in t.lower()).split(" ") if any(unicodedata.category(c)[0] == "L" for c in w)]
    seen, total = defaultdict(Counter), Counter()
    for lang, t in rows:
        for w in words(t):
            seen[lang][w] += 1
            total[lang] += 1
    langs = sorted(total)
    for lang in langs:
        seen[lang] = Counter({w: n for w, n in seen[lang].items() if n > 1})
    known = sorted({w for c in seen.values() for w in c})

    def logs(counts, sizes, number):
        raw = [math.log((c + 0.5) / (s + 0.5 * number)) for c, s in zip(counts, sizes, strict=True)]
        return [max(x, max(raw) - 6.0) for x in raw]

    by_word = {w: logs([seen[x][w] for x in langs], [total[x] for x in langs], len(known)) for w in known}
    by_gram = []
    for n in range(1, 6):
        held = defaultdict(lambda: [0.0] * len(langs))
        for w in known:
            for g in (f"\0{w}\0"[i : i + n] for i in range(len(w) + 3 - n)):
                for j, x in enumerate(langs):
                    held[g][j] += math.log1p(seen[x][w])
        sizes = [sum(v[j] for v in held.values()) for j in range(len(langs))]
        often = {g: v for g, v in held.items() if sum(v) >= (2.0 if n > 2 else 0.5)}
        by_gram.append({g: logs(v, sizes, len(often)) for g, v in often.items()})

    def score(w):
        if w in by_word:
            return by_word[w]
        for n in range(5, 0, -1):
            hit = [by_gram[n - 1][g] for g in (f"\0{w}\0"[i : i + n] for i in range(len(w) + 3 - n)) if g in by_gram[n - 1]]
            if hit:
                return [sum(x) / len(hit) for x in zip(*hit, strict=True)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        sums = [sum(x) for x in zip(*map(score, words(t)), strict=True)]
        out.append(langs[max(range(len(langs)), key=lambda j: sums[j])] if sums else "und")
    return out


def test_language_against_a_plain_version(spark, texts):
    rows = [(i, r["text"], r["lang"]) for i, r in list(texts.items())[:60]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(frame, language.fit(frame.filter("doc_id % 3 > 0"))).collect()}
    learned = {t: (x, t) for i, t, x in rows if i % 3 > 0 and x is not None and t is not None}  # a text counts once
    expect = plain_language(learned.values(), [t or "" for _, t, _ in rows])
    assert [got[i] for i, _, _ in rows] == expect


def test_a_heavy_text_counts_once(spark):
    rows = [("aa", "kato kata kato")] * 300 + [("bb", "zuma zume zuma"), ("bb", "kato zume"), ("aa", "kata kato")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    once = spark.createDataFrame(sorted(set(rows)), frame.schema)
    a, b = language.fit(frame), language.fit(once)
    assert a.words == b.words and (a.word_scores == b.word_scores).all()
    bad = spark.createDataFrame([("you idiot of a fool", 1)] * 400 + [(f"fine day number {i} here", 0) for i in range(40)] + [(f"idiot fool {i}", 1) for i in range(40)], "text string, toxic int")
    a, b = toxicity.fit(bad), toxicity.fit(bad.distinct())
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights) and len(a.keys)
    # the smallest hashes, exactly as many as asked for
    few = toxicity.fit(bad, most_texts=10, features=50)
    assert len(few.keys) <= 50


def test_language_backs_off_to_shorter_ngrams():
    import pyarrow as pa

    model = language.Model([("aa", "kato", 5), ("aa", "kata", 4), ("bb", "zuma", 5), ("bb", "zume", 4)], {"aa": 9, "bb": 9})
    langs, score = model.predict(pa.array(["kato", "KATOX", "zumx", "123", "", "qqq"], pa.large_string()))
    assert langs[:5] == ["aa", "aa", "bb", "und", "und"] and score[0] > 0.9 and score[3] == 0


def test_toxicity(spark, data, docs, edge_docs, no_docs):
    bad = ["idiot", "moron", "scum"]
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "ru") for b in ("ta", "ne", "so", "pi", "gu")]
    rows = []
    for i in range(900):
        w = [words[k] for k in rng.integers(0, 25, 40)]
        if i % 5 == 0:
            for _ in range(2):
                w.insert(int(rng.integers(0, len(w))), bad[int(rng.integers(0, 3))])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.filter("doc_id < 600"))
    got = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    assert all(got[i]["predicted"] == t for i, _, t in rows[600:])
    edge = toxicity.score(edge_docs, model).collect()
    assert len(edge) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in edge)
    assert toxicity.score(no_docs, model).count() == 0
    flat = toxicity.fit(frame.filter("toxic = 0"))
    assert all(r["score"] < 0.01 for r in toxicity.score(frame, flat).collect())


def test_toxicity_on_the_labels(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").collect()}
    got = [r for r in queries.op2_toxicity(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    hit = sum(r["predicted"] and truth[r["doc_id"]] for r in got)
    false, missed = sum(r["predicted"] for r in got) - hit, sum(truth[r["doc_id"]] for r in got) - hit
    assert len(got) > 50 and 2 * hit >= 1.2 * (hit + (false + missed) / 2), (hit, false, missed)


def test_count_ratios_against_plain_counts(spark):
    rows = [("bad cat", 1), ("bad bad dog", 1), ("good cat", 0), ("good dog", 0), ("bad cow", 1), ("good cow", 0), ("bad owl", 1), ("good owl", 0)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), features=100)
    held = {x: Counter(g for t, y in rows if y == x for g in {f" {t} "[i : i + n] for n in toxicity.ORDERS for i in range(len(t) + 3 - n)}) for x in (0, 1)}
    grams = {g for c in held.values() for g in c}
    keys = {g: int(toxicity.grams(np.array([*map(ord, g), 0], np.uint32), len(g))[0]) for g in grams}
    often = {keys[g] for g in grams if held[0][g] + held[1][g] >= toxicity.LEAST}
    assert set(model.keys.tolist()) == often
    sign = {keys[g]: np.sign(held[1][g] - held[0][g]) for g in grams}
    assert all(w * sign[int(k)] >= 0 for k, w in zip(model.keys, model.weights, strict=True))


def test_toxicity_of_long_texts_in_parts(monkeypatch):
    import pyarrow as pa

    keys = np.unique(toxicity.grams(np.array([ord(c) for c in " idiot \0"]), 6))
    model = toxicity.Model(keys[keys != 0], np.ones(len(keys[keys != 0])), -1.0)
    texts = pa.array(["aaa " * 400 + "Idiot " + "bb " * 300, "x", ""], pa.large_string())
    whole = model.predict(texts)
    for size in (7, 50, 1603):
        monkeypatch.setattr(toxicity, "CHUNK", size)
        assert np.allclose(model.predict(texts), whole)
    assert whole[0] > 0.5 > whole[1]


# ---------------------------------------------------------------- chat


def test_perspectives_make_whole_dialogues(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, None, None, "late"), (1, 3, "ann", None), (None, 0, "ann", "x"), (2, 0, "system", "alone")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("label", F.lit(1)).withColumn("block", F.lit(2))).collect()
    by = defaultdict(list)
    for r in got:
        by[r["conv_id"], r["perspective"]].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for (_, who), part in by.items():
        part.sort(key=lambda r: r["position"])
        text = "".join(r["rendered"] for r in part)
        assert [r["position"] for r in part] == list(range(len(part)))
        for r in part:
            assert text[r["start"] : r["end"]] == r["rendered"]
            assert r["target"] == (r["speaker"] == who) and r["label"] == ("system" if r["speaker"] == "system" else "assistant" if r["target"] else "user:" + r["speaker"])
            if r["target"]:
                assert text[r["mask_start"] : r["mask_end"]].endswith("<|end|>\n") and text[r["mask_start"] - 3 : r["mask_start"]] == "|>\n"
            else:
                assert r["mask_start"] == r["mask_end"] == -1
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_perspectives_of_very_long_turns(spark):
    long = "Öl " * 500_000
    got = {(r["perspective"], r["position"]): r for r in chat.rotate(spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", "x")], "conv_id long, turn long, role string, text string")).collect()}
    for who in "ab":
        first, last = got[who, 0], got[who, 1]
        assert first["end"] == last["start"] == len(first["rendered"]) and long in first["rendered"]
    assert got["a", 0]["mask_end"] - got["a", 0]["mask_start"] == len(long) + 8


def test_one_long_conversation_is_spread(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), (F.col("id") % 700).alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.lit("text").alias("text"))
    got = chat.rotate(rows)
    part = got.filter("perspective = 'a'").orderBy("position").collect()
    assert [r["position"] for r in part] == list(range(3000)) and all(x["end"] == y["start"] for x, y in zip(part, part[1:], strict=False))


def test_long_texts_are_cut_where_no_token_spans(monkeypatch):
    import pyarrow as pa

    path = queries.vocabulary("byte_bpe_50k.json")
    assert token_counts.cuts_at_spaces(path) and not token_counts.cuts_at_spaces(queries.vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(6)
    bits = ["word", "it's", " two  spaces", "x\ty", "12 34", "a. b", "Öl", "e\u0301", "日本", "\n\n", "don't we", "<|endoftext|>", "q<|endoftext|> r"]
    texts = [" ".join(bits[k] for k in rng.integers(0, len(bits), 400)) for _ in range(6)] + ["", "x" * 900]
    whole = [len(x) for x in token_counts.tokenizer(path).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_counts, "PART", 50)
    assert len(token_counts.in_parts(texts[0])) > 5 and "".join(token_counts.in_parts(texts[0])) == texts[0]
    assert token_counts.Counter(path)(pa.array(texts, pa.large_string())).tolist() == whole
