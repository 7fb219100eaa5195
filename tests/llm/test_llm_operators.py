"""The operators on small awkward tables: nulls, empty and long texts, ties, repeated rows, extra columns, no rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ocellus import runtime
from ocellus.llm import bpe, chat, mixing, neardup, quality, rules, sharding, token_counts, topk, toxicity
from ocellus.runtime import few

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, size long, s string, label string, kept int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ROWS = [
    (1, "one two three <|endoftext|> four  <|endoftext|>", "en", "a", 1),
    (2, None, "en", "a", 1),
    (3, "", None, None, None),
    (4, LONG, "en", "b", 1),
    (4, LONG, "en", "b", 1),
    (5, "one two three", "de", "b", 1),
    (None, "no id", "en", None, 1),
    (None, "no id either", "en", "c", 1),
    (6, "  \n\t ", "en", "c", 1),
    (7, "x²́ 漢字 don't", "zz", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 9, "clash", "clash", 0) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (4, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_token_counts(docs, none):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    for head in (0, 4, 262_144):
        got = token_counts.count_tokens(docs, path, head_size=max(head, 1)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(none, path).count() == 0


def test_long_pre_tokens_are_counted_where_they_stand(spark):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["=" * 300 + " a", "=" * 300 + f" {'xy' * 5000}", "-" * 256, " " * 20_000 + "x"] * 3
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_bpe_round_trip(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in got) == Counter((r[0], (r[1] or "").encode()) for r in ROWS)
    assert bpe.encode(none, path).count() == 0


def test_mix_reaches_its_targets(docs, none):
    mixed = mixing.mix(docs, 1000).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "draws").collect()
    assert len(mixed) == len(ROWS) and mixing.mix(none).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in mixed)
    assert sum({r.source: r.target for r in mixed}.values()) == pytest.approx(1.5 * sum(r["size"] for r in mixed))
    again = mixing.mix(docs, 1000).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "draws").collect()
    assert Counter(map(str, mixed)) == Counter(map(str, again))
    rows = mixing.mixed_rows(docs, 1000)
    assert rows.columns == docs.columns and rows.count() == sum(len(r.draws) for r in mixed)


def test_shards_are_found_alike_by_broadcast_and_by_join(spark, docs, monkeypatch):
    many = docs.unionByName(spark.createDataFrame([(1000 + i, f"w{i} " * (i % 40), "en", f"s{i % 7}", 0, "", 0, "", "", 0) for i in range(700)], DOCS))
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    key = lambda: sorted((str(r.row), r.size, r.taken, str(r.draws)) for r in mixing.mix(many, 400).collect())
    near = key()
    assert max(d.count("shard=") for *_, d in near) == 2 and len({d for *_, d in near}) > 20
    monkeypatch.setattr(mixing, "BROADCAST_RANGES", 0)
    monkeypatch.setattr(mixing, "_GROUP", 4)
    assert key() == near
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert key() == near


def test_water_level(spark):
    sized = spark.createDataFrame([("=a", 10), ("=b", 100), ("=c", 100)], "s string, size long")
    got = {r.s: r.target for r in mixing._sources(sized).collect()}  # weights 5, 2, 1; 315 words; a stops at 20
    assert got["=a"] == 20 and got["=b"] == pytest.approx(295 * 2 / 3) and got["=c"] == pytest.approx(295 / 3)


def test_split_tree_keeps_quotas(spark):
    q = spark.createDataFrame([([100, 50, 0, 7, 1000],)], "quota array<long>")
    got = mixing.split_tree(q, 11).orderBy("shard").collect()
    assert [sum(x) for x in zip(*(r.quota for r in got), strict=True)] == [100, 50, 0, 7, 1000]
    assert all(sum(r.quota) in (105, 106) for r in got)
    assert [r.first for r in got] == [[sum(s.quota[i] for s in got[:k]) for i in range(5)] for k in range(11)]


def test_top_k_edge_cases(spark):
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [-1.0, -0.001]), (7, [1.0, 2.0, 3.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(v, v.where("vec_id % 100 = 0")).collect()
    best = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0)
    assert best == [(1, 1, 1024**2 + 512**2), (2, 100, 1024**2 + 512**2), (3, 6, -(1024**2) - 1024)]
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0


def test_classifier_edges(docs, none, labels):
    for op, fit in ((quality, quality.learn), (toxicity, toxicity.learn)):
        model = fit(docs, labels)
        got = op.score(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= op.THRESHOLD) for r in got)
        assert all(not r.held_out for r in got if r.doc_id is None)
        assert op.score(none, fit(none, labels.where("false"))).count() == 0


def test_chat_digests(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "</s>[INST] a\\b", 1), (1, 1, "assistant", None, 1), (2, None, None, "é", 1), (2, 0, "assistant", "é" * 500, 1), (None, 3, "user", "x", 1)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(conv, path), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n\nassistant\n</s>[INST] a\\b\n") and got[1].loss_sha256 == sha("</s>[INST] a\\b") and got[1].n_turns == 3
    assert got[2].turns_sha256 == sha("\né\nassistant\n" + "é" * 500 + "\n") and got[2].loss_chars == 500 and got[None].loss_chars == 0
    whole = {r.conv_id: r for r in chat.assemble(chat.format_turns(conv, path)).collect()}
    t = chat.template(path)
    kept = [i for i, m in zip(whole[1].ids, whole[1].mask, strict=True) if m]
    assert chat.unescape(t.decode(kept)) == "</s>[INST] a\\b"
    assert chat.read_back(chat.format_turns(conv.where("false"), path), path).count() == 0


def test_chat_takes_long_runs(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    text = " " * 1_000_000 + "x"
    got = chat.read_back(chat.format_turns(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string"), path), path).collect()
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in got] == [(1, len(text), hashlib.sha256(text.encode()).hexdigest())]


def test_shards_hold_every_row(spark, docs, tmp_path):
    more = docs.withColumn("__piece", F.lit(1)).withColumn("path", F.lit("clash")).withColumn("tier", F.lit("clash"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000, fanout=2)
    with pytest.raises(ValueError, match="nothing"):
        store.read()
    for i in range(3):
        store.append(more, i)
    before = store.versions()[-1]
    store.compact()
    rows = store.read().select("row.*")
    key = lambda df: Counter(map(str, df.collect()))
    assert rows.columns == more.columns and key(rows) == {k: 3 * n for k, n in key(more).items()}
    assert len(store.manifest()) < 3 * 4 and store.versions()[-1] > before
    assert key(store.read(before).select("row.*")) == key(rows)  # an older version can still be read
    last = store.manifest()
    store.append(more.where("false"))
    assert store.manifest() == last
    sized = store.read().join(store.sizes(), "path").groupBy("path", "shard_rows").count().collect()
    assert all(r["count"] == r.shard_rows for r in sized) and len(sized) == len(last)


def test_one_writer_of_a_version_wins_and_orphans_go(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000, fanout=2)
    store.append(docs)
    for _ in range(2):
        with pytest.raises(sharding.CommitConflict):
            store.commit([], store.versions()[-1], docs.schema)
    listed = {s.path for s in store.manifest()}
    store._written(docs, 0)  # an attempt that ends before its commit
    files = lambda: {f"file://{p}" for p in tmp_path.glob("s/shards/**/*.parquet")}
    assert {p.replace("file:///", "file:/") for p in files()} > {p.replace("file:///", "file:/") for p in listed}
    store.vacuum(store.versions()[-1])
    assert len(files()) > len(listed)  # young ones may be about to be listed
    store.vacuum(store.versions()[-1], orphan_seconds=-60)
    assert len(files()) == len(listed) and store.read().count() == len(ROWS)
    assert not list(tmp_path.glob("s/_draft*"))


def test_a_store_of_empty_tables(spark, none, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(none)
    store.vacuum(store.compact())
    assert store.read().select("row.*").columns == none.columns and store.read().join(store.sizes(), "path").count() == 0


def test_large_partitions_become_target_sized_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * 68) for i in range(400)], "doc_id long, text string").coalesce(1)  # 100 bytes each
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000)
    store.append(rows)
    assert all(s.n_bytes < 2000 and s.tier < 2 for s in store.manifest())
    store.compact()
    assert all(s.n_bytes <= 5000 for s in store.manifest()) and sum(s.tier == 2 for s in store.manifest()) >= 8
    got = store.read().select("row.*")
    assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == list(range(400))


def test_rules_edges(docs, none):
    got = {(r.doc_id, r.n_words): r for r in rules.judge(docs).collect()}
    assert rules.judge(docs).count() == len(ROWS) and rules.judge(none).count() == 0
    assert got[(2, 0)].base_failed and not got[(2, 0)].kept and got[(6, 0)].word_chars == 0
    assert got[(4, 30_000)].n_repeat_words == 30_000 and got[(4, 30_000)].base_failed


def test_perplexity_rejects_planted_junk_and_keeps_clean_texts(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeiou" if i % 2 else "bdklmnrst") for i in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, range(len(words), 0, -1), k=n))
    clean = [(i, prose(rng.randint(150, 400)), "en") for i in range(300)]
    junk = [(1000 + i, " | ".join(rng.sample(words, 150)), "en") for i in range(4)]  # fragments
    junk += [(1100 + i, prose(200).replace(" ", "*** "), "en") for i in range(4)]  # the same sign again and again
    junk += [(1200 + i, "".join(rng.choice("qwxzvjfghp   ") for _ in range(1500)), "en") for i in range(2)]  # keys hit at random
    kept = {r.doc_id: (r.kept, r.base_failed) for r in rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert not any(kept[i][1] for i, *_ in clean + junk)
    assert not any(kept[i][0] for i, *_ in junk)
    assert sum(not kept[i][0] for i, *_ in clean) <= 3


def test_bands_count_exact_copies_once(spark):
    scored = [("en", f"{i}", ppl, 10**9, False) for i, ppl in enumerate(range(1000, 1101, 5))]
    kinds = "l string, h string, log_ppl long, n_bytes long, base_failed boolean"
    alone, copied = (rules.bands(spark.createDataFrame(x, kinds)).first() for x in (scored, scored + 100 * scored[:1]))
    assert alone == copied and (alone.mid, alone.low, alone.high) == pytest.approx((1050, rules.WIDTH * 1.4826 * 25, rules.WIDTH * 1.4826 * 25))


CORPUS = ["the cat sat on the mat", "the dog sat on the cat", "a cat and a dog", "the dog sat on the cat", "nothing like it", "le chat dort"]


def test_ngrams_count_in_other_texts(spark):
    docs = spark.createDataFrame([("fr" if i == 5 else "en", t) for i, t in enumerate(CORPUS)], "lang string, text string")
    grams = lambda t: {(b"\0" * 4 + t.encode())[i : i + 5] for i in range(len(t))}
    want = Counter(g for t in set(CORPUS[:5]) for g in grams(t))
    got = {(r.l, r.g.to_bytes(5, "big")): r.c for r in rules.ngram_counts(docs).collect()}
    assert got == {("=en", g): n - 1 for g, n in want.items() if n > 1}


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([("en", t) for t in CORPUS], "lang string, text string")
    counts = rules.ngram_counts(docs)
    model = rules._packed(rules.kneser_ney(counts))["=en"]
    contexts = {0, 1, ord("t"), *(r.g >> 8 for r in counts.collect())}
    for ctx in [*contexts, int.from_bytes(b"xyzt", "big")]:
        p = np.exp(-rules.UNIT * model.cost(np.array([ctx << 8 | x for x in range(256)], np.uint64)))
        assert abs(p.sum() - 1) < 0.02, ctx
    # By hand, of the highest order: (c - d) / total + weight * lower order.
    top = {r.g: r.c for r in counts.collect()}
    n = Counter(top.values())
    y = n[1] / (n[1] + 2 * n[2])
    d = {c: min(max(c - (c + 1) * y * n[c + 1] / n[c] if n[c] else 0.5 * c, 0.1), c - 0.1) for c in (1, 2, 3)}
    g = next(iter(top))
    mine = {x: c for x, c in top.items() if x >> 8 == g >> 8}
    total, left = sum(mine.values()), sum(d[min(c, 3)] for c in mine.values())
    lower = model.cost(np.array([(g & (1 << 32) - 1) | 255 << 32], np.uint64))[0]  # no text has byte 255
    assert np.exp(-rules.UNIT * model.cost(np.array([g], np.uint64))[0]) == pytest.approx((top[g] - d[min(top[g], 3)]) / total + left / total * np.exp(-rules.UNIT * lower), rel=1e-3)


def test_a_small_model_is_kept_in_few_files(spark, monkeypatch):
    files, cut = [], rules.cut_lineage
    monkeypatch.setattr(rules, "cut_lineage", lambda df: files.append(cut(df)) or files[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = cut(rules.ngram_counts(spark.createDataFrame([("en", t) for t in CORPUS], "lang string, text string")))
        files.clear()
        assert rules.kneser_ney(counts).rdd.getNumPartitions() <= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 10 and all(df.rdd.getNumPartitions() == 1 for df in files[1:])


def test_models_that_are_not_broadcast_score_alike(spark, docs, monkeypatch):
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(100 + i, t, "en" if i % 2 else "xx") for i, t in enumerate(CORPUS * 2)], "doc_id long, text string, lang string"))
    once = Counter(map(tuple, rules.judge(more).collect()))
    for room in (0, 100):
        monkeypatch.setattr(rules, "BROADCAST_ENTRIES", room)
        monkeypatch.setattr(rules, "BLOCK_BYTES", 100)
        assert Counter(map(tuple, rules.judge(more).collect())) == once


def components(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def near_texts(groups, most, changes, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " ", "one", "One", "one two", "two one"]
    for _ in range(groups):
        base = [word() for _ in range(60)]
        for _ in range(rng.randint(1, most)):
            copy = base[:]
            for _ in range(rng.randint(0, changes)):
                copy[rng.randrange(60)] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("groups", "most", "changes", "block"), [(12, 14, 6, 1024), (3, 60, 9, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, groups, most, changes, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_texts(groups, most, changes)
    own = neardup.Shingler()
    roots = components([set(own.set_of(t or "").tolist()) for t in texts])
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class int")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in got)
    kept = neardup.kept_rows(df.unionByName(df.where("doc_id > 3"))).collect()
    assert Counter(r.doc_id for r in kept) == Counter(i for i, r in enumerate(roots) if r == i)


def test_all_pairs_of_a_large_bucket_are_compared_once(spark):
    import numpy as np

    rng = random.Random(3)
    members = [(k, i, rng.randint(0, 5) if k else i, 10, [1]) for k in (0, 1) for i in range(90)]
    old, neardup.BLOCK = neardup.BLOCK, 7
    rows = neardup._in_tasks(spark.createDataFrame(members, "key long, id long, label long, n long, keys array<long>")).collect()
    neardup.BLOCK = old
    tasks: dict = {}
    for r in rows:
        tasks.setdefault((r.key, r.x, r.y), []).append((r.side, r.id, r.label))
    assert max(map(len, tasks.values())) < 60
    met = Counter()
    for (key, _, _), held in tasks.items():
        two = any(side for side, *_ in held)
        for s, i, a in held:
            for t, j, b in held:
                if a != b and (s < t if two else i < j):
                    met[key, min(i, j), max(i, j)] += 1
    labels = {(k, i): label for k, i, label, *_ in members}
    assert met == Counter((k, i, j) for k in (0, 1) for j in range(90) for i in range(j) if labels[k, i] != labels[k, j])


def test_a_class_in_many_mixed_buckets_is_dealt_once_a_partial_key(spark, monkeypatch):
    texts, dealt, deal = near_texts(3, 60, 9), [], neardup._in_tasks
    monkeypatch.setattr(neardup, "_in_tasks", lambda members: dealt.append(members) or deal(members))
    roots = components([set(neardup.Shingler().set_of(t or "").tolist()) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(roots))
    rows = dealt[0].groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")).collect()
    assert len(rows) > 50 and all(r.n == r.keys <= neardup.KEYS for r in rows)


def test_a_class_in_many_large_buckets_is_one_row(spark, monkeypatch):
    import numpy as np

    found, groups, buckets, grouped = [], [], neardup._buckets, neardup._groups
    monkeypatch.setattr(neardup, "_buckets", lambda classes: found.append((classes, buckets(classes))) or found[0][1])
    monkeypatch.setattr(neardup, "_groups", lambda *tables: groups.append(grouped(*tables)) or groups[0])
    neardup.near_duplicates(spark.createDataFrame(list(enumerate(near_texts(3, 60, 9))), "doc_id long, text string")).collect()
    classes, members = found[0][0].collect(), {}
    keys, sizes = {r.id: r["keys"] for r in classes}, {r.id: r.n for r in classes}
    for i, k in keys.items():
        for b, key in enumerate(neardup.table_keys(np.array([k]).view(np.uint64))[0].tolist()):
            members.setdefault((b // neardup.KEYS, key), []).append(i)
    large = {(i, a) for (a, _), ids in members.items() if len(ids) > neardup.SMALL for i in ids}
    rows = found[0][1].collect()
    got = {r.v: r["mask"] for r in rows if r.u is None}
    assert len(got) > 50 and len(rows) == len({(r.u, r.v) for r in rows})
    assert {(i, a) for i, bits in got.items() for a in range(64) if bits >> a & 1} == large
    assert Counter((r.id, r.key) for r in groups[0].collect()) == Counter((i, keys[i][a]) for i, a in large)
    pairs = {(min(r.u, r.v), max(r.u, r.v)) for r in rows if r.u is not None}
    for i, j in {(i, j) for ids in members.values() for i in ids for j in ids if i < j}:  # whoever shares a bucket meets where it is asked for
        first = next(a for a in range(neardup.KEYS) if keys[i][a] == keys[j][a])
        assert (i, j) in pairs or {(i, first), (j, first)} <= large or 100 * min(sizes[i], sizes[j]) < 80 * max(sizes[i], sizes[j])


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(6)
    a, b = (" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(2))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, "alone here"), (5, a)]
    for order in (rows, rows[::-1]):
        got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect())
        assert got == Counter({(5, 59, 5, True): 3, (6, 60, 5, False): 1, (7, 60, 5, False): 1, (8, 1, 8, True): 1})


def files_kept(spark, monkeypatch, module, run, most):
    """How many files each of a step's tables is kept in, with ``most`` shuffle partitions that aren't coalesced."""
    files, cut, size = [], module.cut_lineage, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(module, "cut_lineage", lambda df: files.append(cut(df)) or files[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(most))
    try:
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", size)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return [df.rdd.getNumPartitions() for df in files]


def test_few_partitions_grow_with_rows(spark):
    spread = spark.range(100).repartition(40)
    assert [few(spread, n).rdd.getNumPartitions() for n in (0, 1, 10_000, 10_001, 250_000, 10**9)] == [1, 1, 1, 2, 25, 40]


def test_small_tables_are_kept_in_few_files(spark, monkeypatch):
    texts = near_texts(3, 60, 9)
    df = spark.createDataFrame([(i, t, "en", "a" if i % 3 else "b") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).cache()
    kept = files_kept(spark, monkeypatch, neardup, lambda: neardup.kept_rows(df).count(), 24)
    assert len(kept) > 8 and sorted(kept)[-2] <= 2  # links across a large group's blocks stay as they are dealt
    assert max(files_kept(spark, monkeypatch, rules, lambda: rules.kept_rows(df).count(), 24)) <= 2
    assert set(files_kept(spark, monkeypatch, mixing, lambda: mixing.mix(df).count(), 24)) == {1}
    df.unpersist()


def test_token_counts_come_in_few_files(spark, docs, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"))
        assert counts.rdd.getNumPartitions() == 1 and counts.count() == len(ROWS)
        monkeypatch.setattr(runtime, "ROWS_A_FILE", 20)  # a long text is the work of many short ones
        assert token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rejected_rows_are_told_without_a_shuffle_of_texts(spark, monkeypatch):
    texts = near_texts(4, 12, 6)
    df = spark.createDataFrame([*enumerate(texts), *list(enumerate(texts))[20:]], "doc_id long, text string").coalesce(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = neardup.kept_rows(df)
        assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
        assert sorted(near.collect(), key=str) == sorted(neardup.kept_rows(df).collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_duplicate_edges(docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and neardup.near_duplicates(none).count() == 0
    assert [r.component_id for r in got if r.doc_id == 4] == [4, 4] and all(r.kept for r in got if r.doc_id is None)
