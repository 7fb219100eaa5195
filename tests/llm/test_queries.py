"""Every registered query of this subpackage over a real table, against libraries and brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from ocellus.llm import chat, queries, rules, toxicity
from ocellus.runtime import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").collect()


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, sf_dir, documents):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {r.doc_id: len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in documents}
    got = queries.op1_token_counts(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((r.doc_id, len((r.text or "").encode()), n[r.doc_id], n[r.doc_id] > 1024) for r in documents)


def targets(sizes: dict) -> dict:
    """By sharing again and again until no source is above its most."""
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1) * len(sizes), strict=False))
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def test_op2(spark, sf_dir, documents):
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in documents}
    source = {r.doc_id: r.source for r in documents}
    sizes = defaultdict(int)
    for r in documents:
        sizes[r.source] += size[r.doc_id]
    want = targets(sizes)
    got = queries.op2_source_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    most = {s: max((size[i] for i in size if source[i] == s), default=0) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, queries.op2_source_mixing(spark, sf_dir).collect()))


def test_op3(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = queries.op3_exact_top_k(spark, sf_dir).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(con.execute(queries.ORACLE_SQL["op3_exact_top_k"]).fetchall())


@pytest.mark.parametrize(("query", "label", "folds", "fold", "cut", "size", "wrong"), [("op4_quality_classifier", "quality", 4, 2, 0.7, "sf0.1", 0.02), ("op7_toxicity", "toxic", 5, 0, 0.5, "sf0.01", 0.05)])
def test_classifiers_on_rows_they_never_saw(spark, query, label, folds, fold, cut, size, wrong):
    sf_dir = f"/root/testdata/{size}"
    told = {r.doc_id: r[label] for r in table(spark, sf_dir, "labels").collect()}
    got = queries.QUERIES[query](spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    held = [(r.predicted, told[r.doc_id]) for r in got if r.held_out and told.get(r.doc_id) is not None]
    assert len(held) > 50 and sum(p != y for p, y in held) <= wrong * len(held)


def test_op5(spark, sf_dir):
    rows = defaultdict(list)
    for r in table(spark, sf_dir, "conversations").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv, turns in rows.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{chat.TURN}{chat.escape(role)}{chat.BODY}{chat.escape(t)}{chat.END}" for _, role, t in turns)
        want[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()), len(loss), sha(loss.encode()), len(whole))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in queries.op5_chat_formatting(spark, sf_dir).collect()}
    assert got == want


def test_op6(spark, sf_dir, documents):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in documents:
        ids = lib.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_byte_bpe(spark, sf_dir).collect()) == want


def test_op8(spark, sf_dir, documents):
    got = queries.op8_sharding(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((r.doc_id, len((r.text or "").encode())) for r in documents)
    assert sum(1 / r.shard_rows for r in got) == pytest.approx(len({(r.shard_rows, r.shard_bytes) for r in got}), abs=3)


def test_op9(spark, sf_dir, documents):
    want = Counter((r.doc_id, *rules.base_counts((r.text or "").encode())) for r in documents)
    got = queries.op9_quality_rules(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert sum(not r.kept and not r.base_failed for r in got) <= 0.1 * len(got)


def brute_components(documents):
    sets = {}
    for r in documents:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets, key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if 80 * len(sets[j]) > 100 * len(sets[i]):
                break
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_op10(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = brute_components(table(spark, sf_dir, "documents").collect())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_near_duplicates(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    linked = [i for i, (_, c, _) in want.items() if c != i]
    assert linked and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i][1] == i for i, (_, c, _) in want.items() if c == i)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents with null and repeated ids, null, empty and long texts, a toxic one without an id, and near copies."""
    root = str(tmp_path_factory.mktemp("small"))
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    clean = docs.where("n_chars between 1500 and 3000").orderBy("doc_id").limit(60)
    model = toxicity.Scorer(toxicity.learn(docs, table(spark, "/root/testdata/sf0.01", "labels")))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in clean.collect() if model.score(r.text) < 0.1]
    toxic = next(r.text for r in docs.orderBy("doc_id").collect() if r.text and model.score(r.text) > 0.99)
    extra = [(None, toxic, "en", "a", 1), (None, rows[0][1], "en", "a", 1), (rows[1][0], toxic, "en", "a", 1), rows[2], (10**9, rows[3][1] + " x", rows[3][2], "a", 1), (10**9 + 1, None, None, None, None), (10**9 + 2, "", "en", "a", 0), (10**9 + 3, "w " * 100_000, "en", "a", 1)]
    spark.createDataFrame(rows + extra, docs.schema).write.parquet(f"{root}/documents.parquet")
    table(spark, "/root/testdata/sf0.01", "labels").write.parquet(f"{root}/labels.parquet")
    docs.write.parquet(f"{root}/all.parquet")
    return root, rows, toxic


def test_stages_judge_rows_not_ids(spark, small, monkeypatch):
    root, rows, toxic = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    learned = toxicity.learn(spark.read.parquet(f"{root}/all.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    monkeypatch.setattr(toxicity, "learn", lambda *_: learned)
    texts = lambda df: Counter(r.text for r in df.collect())
    left = corpus_pipeline.toxic_out(spark, docs, root)
    assert texts(left) == Counter({t: n for t, n in texts(docs).items() if t != toxic}) and left.columns == docs.columns
    ruled = corpus_pipeline.rules_out(spark, left, root)
    verdict = {(r.l, r.h): r.kept for r in rules.verdicts(left).collect()}
    want = Counter(r.text for r in left.collect() if verdict["~" if r.lang is None else f"={r.lang}", hashlib.md5((r.text or "").encode()).hexdigest()])
    assert texts(ruled) == want and None not in want and "" not in want and want[rows[0][1]] == 2
    single = corpus_pipeline.duplicates_out(spark, ruled, root)
    own = brute_components({r.doc_id: r for r in ruled.collect() if r.doc_id is not None}.values())
    first = {r.text for r in ruled.collect() if r.doc_id is not None and own[r.doc_id][2]}
    assert rows[3][1] + " x" not in first and texts(single) == Counter(first) + Counter([rows[0][1]])  # the row without an id stays
    mix = corpus_pipeline.mixed(spark, single, root)
    assert mix.columns == docs.columns and set(texts(mix)) <= set(texts(single))
    assert corpus_pipeline.encoded(spark, mix, root).count() == mix.count()


def test_stages_of_an_empty_table(spark, small):
    root = small[0]
    none = spark.read.parquet(f"{root}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, root).count() == 0, name
