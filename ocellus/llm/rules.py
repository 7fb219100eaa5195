"""Quality rules: simple counts, and perplexity under an n-gram model of each language.

The model is an interpolated modified Kneser-Ney model of order 5 over the bytes of texts. Spark counts n-grams over all whole
texts. What counts is in how many distinct texts an n-gram is found, less one: a text can't vouch for itself, and exact copies
count as one text. So junk that is like nothing else stays unlikely, however often it says the same. Every order's
probabilities follow from these counts, and the model has as many entries as the corpus has n-grams that two texts share.

Scoring looks n-grams up in arrays sorted by a hash, with an index of where each leading part of a hash begins. The models of as
many languages as ``BROADCAST_ENTRIES`` has room for are broadcast; texts in the others are dealt into blocks, and each block is
joined with those entries of its languages' models that its texts need. A document is rejected if its log perplexity lies outside
its language's band, which reaches ``WIDTH`` robust standard deviations to either side of the median over all distinct documents
that passed the simple rules. Below and above it, deviations are measured apart; they are of log perplexities brought to
a length of ``LENGTH`` bytes, since those of short texts scatter more.

Defined cases: a null text has no words; a null language is one of its own; repeated rows are judged each; a null ``doc_id`` stays
null; a text without any byte has no perplexity and lies in every band; a language in which no two texts share an n-gram has no
model but equal chances, and so a band of its own; other columns are ignored whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.batches import slices
from ocellus.runtime import cut_lineage, few, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MOST_REPEATED = 50
ORDER = 5
#: How far the band of log perplexity reaches to either side, in robust standard deviations of that side.
WIDTH = 8.0
#: Bytes of a text whose log perplexity scatters by chance as much as it does from text to text.
LENGTH = 400
#: And at least so many thousandths of a nat, where texts hardly differ.
LEAST = 10
#: Most model entries broadcast, of 12 bytes each.
BROADCAST_ENTRIES = 5_000_000
#: Most rows of small tables (copied texts, discounts, bands) that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts in a block, where models are not broadcast, and in a piece worked on at once: a byte takes up to 100 in arrays.
BLOCK_BYTES, PIECE = 64 << 20, 1 << 20
#: N-grams looked up at once.
LOOKUPS = 1 << 18
#: Rows of models in a task and in a file, where steps between them are kept.
ENTRIES = 500_000
#: Log probabilities are kept in this unit, as integers: sums don't depend on the order of adding.
UNIT = 1e-4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = [np.uint64((1 << 8 * k) - 1) for k in range(ORDER + 1)]


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8: bytes.split parts words at exactly the white space
    that counts here."""
    words = raw.split()
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeated = 0
    if len(words) > 3:
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        w = (h[:-2] * _ODD + h[1:-1]) * _ODD + h[2:]
        ordered = np.sort(w)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            # Equal windows have equal hashes; what has an equal hash is compared as it is.
            at = np.flatnonzero(np.isin(w, again)).tolist()
            often = Counter((words[i], words[i + 1], words[i + 2]) for i in at)
            until = 0  # words before it are counted or in no repeated window
            for i in at:
                if often[words[i], words[i + 1], words[i + 2]] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    return len(words), int(chars), sum(map(raw.count, SYMBOLS.encode())), len(lines) - len(set(lines)), repeated


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of all texts, as a number, and how many bytes each text has. Zeros stand before a text."""
    pad = ORDER - 1
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer((b"\0" * pad).join([b"", *texts]), np.uint8)
    code = flat[: len(flat) - pad].astype(np.uint64)
    for k in range(1, ORDER):
        code <<= np.uint64(8)
        code |= flat[k : k + len(code)]
    real = np.ones(len(code), bool)
    ends = np.cumsum(sizes + pad) - pad  # in ``code``, where the padding after each text begins
    for k in range(pad):
        at = ends + k
        real[at[at < len(code)]] = False
    return code[real], sizes


def _language():
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("~"))


def _text():
    return F.col("text").cast("string")


def _small(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if it is small enough, as counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ngram_counts(docs: DataFrame) -> DataFrame:
    """l (language), g (n-gram) and c (in how many distinct texts but one) over all whole texts, where c is not 0."""
    own = docs.select(_language().alias("l"), _text().alias("text")).where("text <> ''").select("l", F.md5("text").alias("h"), "text")
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    copied = cut_lineage(few(own.groupBy("l", "h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), n))
    weighed = own.join(_small(copied), ["l", "h"], "left").select("l", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("w"), "text")

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        code = code[order]
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return code[begins], np.add.reduceat(weight[order], begins)

    def each(texts: list[bytes], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of the texts, each text's once, and what the texts with it weigh together."""
        code, sizes = codes(texts)
        key = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(8 * ORDER), sizes) | code
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        if (w == 1).all():
            key &= _MASK[ORDER]
            key.sort()
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[begins], np.diff(np.append(begins, len(key))).astype(np.float64)
        return merged([(key & _MASK[ORDER], w[(key >> np.uint64(8 * ORDER)).astype(np.int64)])])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part in slices(batches, PIECE):
            by: dict[tuple[str, bool], list[tuple[bytes, float]]] = {}
            for lang, w, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                by.setdefault((lang, w == 1), []).append((text.encode(), w))
            for (lang, _), rows in by.items():
                held = seen.setdefault(lang, [])
                held.append(each([t for t, _ in rows], np.array([w for _, w in rows])))
                if len(held) > 8:
                    held[:] = [merged(held)]
        for lang, held in seen.items():
            code, weight = merged(held)
            for i in range(0, len(code), 100_000):
                c, w = code[i : i + 100_000], weight[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.view(np.int64)), pa.array(w)], ["l", "g", "c"])

    told = weighed.mapInArrow(tally, "l string, g long, c double").groupBy("l", "g").agg((F.round(F.sum("c")) - 1).cast("long").alias("c"))
    return few(told.where("c > 0"), max(n, size / 2048))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """l, k (1 to ORDER: an n-gram of that order; below 0: a context of so many symbols), g and cost (minus log probability, or minus
    log weight of the lower order, in UNIT)."""
    level = {ORDER: cut_lineage(counts)}
    # No order or context has more rows than the highest order. Few files, since a store may start a process for each that is made.
    parts = math.ceil(level[ORDER].count() / ENTRIES) or 1
    kept = lambda df: cut_lineage(df.coalesce(parts))
    for k in range(ORDER - 1, 0, -1):  # lower orders count distinct symbols before
        level[k] = kept(level[k + 1].groupBy("l", F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c")))
    met = None
    for k, rows in level.items():
        few = rows.groupBy("l").agg(*(F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4))).withColumn("k", F.lit(k))
        met = few if met is None else met.unionByName(few)
    y = "(n1 / nullif(n1 + 2 * n2, 0))"
    cut = [F.least(F.greatest(F.coalesce(F.expr(f"{i} - {i + 1} * {y} * n{i + 1} / nullif(n{i}, 0)"), F.lit(0.5 * i)), F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}") for i in (1, 2, 3)]
    cuts = kept(met.select("l", "k", *cut))
    below, out = None, None
    for k in range(1, ORDER + 1):
        own = level[k].join(_small(cuts.where(F.col("k") == k).drop("k")), "l").withColumn("ctx", F.shiftright("g", 8))
        own = own.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        # d is 0.1 to 2.9, a few values a language: sums of equal terms hardly depend on their order, and costs are rounded.
        contexts = kept(own.groupBy("l", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("left")).withColumn("weight", F.col("left") / F.col("total")))
        p = own.join(contexts, ["l", "ctx"])
        if below is None:
            p = p.withColumn("p", (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") / 256)
        else:
            low = below.select("l", F.col("g").alias("low"), F.col("p").alias("p_low"))
            p = p.withColumn("low", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(low, ["l", "low"]).withColumn("p", (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("p_low"))
        below = kept(p.select("l", "g", "p"))
        entry = below.select("l", F.lit(k).alias("k"), "g", F.round(-F.log("p") / UNIT).cast("int").alias("cost"))
        entry = entry.unionByName(contexts.select("l", F.lit(1 - k).alias("k"), F.col("ctx").alias("g"), F.round(-F.log(F.least("weight", F.lit(1.0))) / UNIT).cast("int").alias("cost")))
        out = entry if out is None else out.unionByName(entry)
    return out.coalesce(2 * parts)


def entry_hash(k, g: np.ndarray) -> np.ndarray:
    """Of order (or context length) and n-gram; distinct for distinct ones."""
    return ((np.asarray(k, np.int64) + ORDER).astype(np.uint64) << np.uint64(8 * ORDER) | np.asarray(g).astype(np.uint64)) * _ODD


class Model:
    """One language's model: costs in an array sorted by hash, and where the hashes with each leading part begin."""

    def __init__(self, hashes: np.ndarray, costs: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.costs = hashes[order], costs[order].astype(np.int32)
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length()))
        leads = np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64)
        self.begins = np.append(np.searchsorted(self.hashes, leads[:-1] << self.shift), len(hashes)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the array, and which hashes are there: from where a hash's leading part begins, one after the other."""
        lead = (h >> self.shift).astype(np.int64)
        at, end = self.begins[lead], self.begins[lead + 1]
        known = np.zeros(len(h), bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.hashes[at[todo]] == h[todo]
            known[todo[same]] = True
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return at, known

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Cost of each n-gram's last symbol after the others."""
        parts = [self._cost(code[i : i + LOOKUPS]) for i in range(0, len(code), LOOKUPS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _cost(self, code: np.ndarray) -> np.ndarray:
        total = np.zeros(len(code), np.int64)
        todo, g = np.arange(len(code)), code
        for k in range(ORDER, 0, -1):
            at, known = self.find(entry_hash(k, g))
            total[todo[known]] += self.costs[at[known]]
            todo, g = todo[~known], g[~known]
            if not len(todo):
                return total
            at, met = self.find(entry_hash(1 - k, g >> np.uint64(8)))
            total[todo[met]] += self.costs[at[met]]
            g = g & _MASK[k - 1]
        total[todo] += round(math.log(256) / UNIT)
        return total

    def __reduce__(self):
        return Model, (self.hashes, self.costs)


def needed(code: np.ndarray) -> np.ndarray:
    """Hashes of all entries that costs of ``code`` may look up."""
    code = np.unique(code)
    found = []
    for k in range(ORDER, 0, -1):
        found += [entry_hash(k, code), entry_hash(1 - k, np.unique(code >> np.uint64(8)))]
        code = np.unique(code & _MASK[k - 1])
    return np.unique(np.concatenate(found))


_NAMES = ["doc_id", "l", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cost", "n_bytes"]
_DDL = "doc_id long, l string, h string, " + ", ".join(f"{n} long" for n in _NAMES[3:])


def _rows(part: pa.RecordBatch, models: dict[str, Model]) -> pa.RecordBatch:
    """``part`` (doc_id, l, h, text) with counts and costs in place of texts."""
    langs, texts = part.column(1).to_pylist(), [(t or "").encode() for t in part.column(3).to_pylist()]
    cost, sizes = np.zeros(len(texts), np.int64), np.array([len(t) for t in texts], np.int64)
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    for lang, rows in by.items():
        code, n = codes([texts[i] for i in rows])
        own = models.get(lang)
        upto = np.concatenate([[0], np.cumsum(own.cost(code) if own else np.full(len(code), round(math.log(256) / UNIT), np.int64))])
        ends = np.cumsum(n)
        cost[rows] = upto[ends] - upto[ends - n]
    base = list(zip(*map(base_counts, texts), strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, pa.int64()) for c in [*base, cost, sizes])], _NAMES)


def _scored(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PIECE):
            yield _rows(part, shared.value)

    return rows.mapInArrow(run, _DDL)


def _scored_in_blocks(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """:func:`_scored` without any model in one place: blocks of texts meet the entries that they need."""
    n = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Kept as a table, so a row's block is the same wherever it is read.
    dealt = written(rows.withColumn("b", F.floor(F.rand(17) * max(1, math.ceil(n / BLOCK_BYTES)))), "blocks")

    def wanted(block: pa.Table) -> pa.Table:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(block["l"].to_pylist(), block["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append((text or "").encode())
        found = {lang: needed(codes(texts)[0]) for lang, texts in by.items()}
        cols = [pa.array([block["b"][0].as_py()] * sum(map(len, found.values())), pa.int64()), pa.array([x for x, h in found.items() for _ in h], pa.string()), pa.array(np.concatenate([*found.values(), np.zeros(0, np.uint64)]).view(np.int64))]
        return pa.Table.from_arrays(cols, ["b", "l", "hash"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(entry_hash(x.column(1).to_numpy(), x.column(2).to_numpy()).view(np.int64)), x.column(3)], ["l", "hash", "cost"])

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        lang = np.array(found["l"].to_pylist(), object)
        hashes, costs = found["hash"].to_numpy().view(np.uint64), found["cost"].to_numpy()
        models = {x: Model(hashes[lang == x], costs[lang == x]) for x in set(lang.tolist())}
        parts = [_rows(p, models) for p in slices(iter(block.select(["doc_id", "l", "h", "text"]).combine_chunks().to_batches()), PIECE)]
        return pa.Table.from_batches(parts, None if parts else pa.schema([(n, pa.string() if n in "lh" else pa.int64()) for n in _NAMES]))

    keys = dealt.groupBy("b").applyInArrow(wanted, "b long, l string, hash long")
    found = keys.join(entries.select("l", "k", "g", "cost").mapInArrow(hashed, "l string, hash long, cost int"), ["l", "hash"])
    return dealt.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(score, _DDL)


def _packed(entries: DataFrame) -> dict[str, Model]:
    """Models of all ``entries``, made from one pair of arrays for each language and partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for x in batches:
            lang = x.column(0).dictionary_encode()
            index, h, cost = lang.indices.to_numpy(), entry_hash(x.column(1).to_numpy(), x.column(2).to_numpy()), x.column(3).to_numpy()
            for i, name in enumerate(lang.dictionary.to_pylist()):
                held.setdefault(name, []).append((h[index == i], cost[index == i]))
        rows = [(name, np.concatenate([h for h, _ in x]).tobytes(), np.concatenate([c for _, c in x]).astype(np.int32).tobytes()) for name, x in held.items()]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:1]] + [pa.array([v], pa.binary()) for v in row[1:]], ["l", "hashes", "costs"])

    found: dict[str, tuple[list[bytes], list[bytes]]] = {}
    for r in entries.select("l", "k", "g", "cost").mapInArrow(pack, "l string, hashes binary, costs binary").collect():
        for held, part in zip(found.setdefault(r.l, ([], [])), (r.hashes, r.costs), strict=True):
            held.append(bytes(part))
    return {lang: Model(np.frombuffer(b"".join(h), np.uint64), np.frombuffer(b"".join(c), np.int32)) for lang, (h, c) in found.items()}


def scores(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, l, h (MD5 of the text), the base counts, base_failed, n_bytes and log_ppl (nats a byte, in whole
    thousandths; null without text)."""
    entries = cut_lineage(kneser_ney(ngram_counts(docs)))
    at_hand, room = [], BROADCAST_ENTRIES
    for n, lang in sorted((r["count"], r["l"]) for r in entries.groupBy("l").count().collect()):
        if n <= room:
            at_hand.append(lang)
            room -= n
        else:
            room = 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("l"), F.md5(F.coalesce(_text(), F.lit(""))).alias("h"), _text().alias("text"))
    if room:
        parts = _scored(rows, _packed(entries))
    else:
        near = F.col("l").isin(at_hand)
        parts = _scored(rows.where(near), _packed(entries.where(near))).unionByName(_scored_in_blocks(rows.where(~near), entries.where(~near)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    ppl = F.when(F.col("n_bytes") > 0, F.round(F.col("cost") * UNIT * 1000 / F.col("n_bytes")).cast("long"))
    return parts.withColumn("base_failed", failed).withColumn("log_ppl", ppl).drop("cost")


def _steady(mid):
    """How far log_ppl is from ``mid``, in thousandths as of a text of any length."""
    return F.round((F.col("log_ppl") - mid) / F.sqrt(1 + LENGTH / F.nullif(F.col("n_bytes"), F.lit(0)))).cast("long")


def bands(scored: DataFrame) -> DataFrame:
    """Per language: l, mid (median of log_ppl), low and high (most that a text may lie below and above it, as :func:`_steady` has it).
    Equal texts count once. Medians are exact: they are taken over counts of whole thousandths."""
    rows = scored.count()
    kept = lambda df: cut_lineage(few(df, rows))
    alike = kept(scored.where("not base_failed and log_ppl is not null").select("l", "h", "log_ppl", "n_bytes").distinct())
    median = lambda c: F.expr(f"percentile({c}, 0.5, n)")
    middle = alike.groupBy("l", "log_ppl").agg(F.count(F.lit(1)).alias("n")).groupBy("l").agg(median("log_ppl").alias("mid"))
    middle = kept(middle)
    off = alike.join(_small(middle), "l").select("l", "mid", _steady(F.col("mid")).alias("z")).groupBy("l", "mid", "z").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: F.expr(f"percentile(abs(z), 0.5, n) filter (where z {c} 0)")
    reach = lambda c: F.greatest(F.lit(WIDTH * 1.4826) * F.col(c), F.lit(float(LEAST)))
    return few(off.groupBy("l", "mid").agg(side("<=").alias("below"), side(">=").alias("above")).select("l", "mid", reach("below").alias("low"), reach("above").alias("high")), rows)


def verdicts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, l, h, the base counts, base_failed, log_ppl, and kept, which follows from l and h alone."""
    scored = cut_lineage(scores(docs))
    told = scored.join(_small(cut_lineage(bands(scored))), "l", "left").withColumn("z", _steady(F.col("mid")))
    inside = F.coalesce(F.col("z").between(-F.col("low"), F.col("high")), F.lit(True))
    return told.withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, log_ppl, and kept."""
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are. A verdict follows from language and text, so that rejected pairs of the
    two tell which rows go, whatever their ids."""
    told = verdicts(docs).where("not kept").select(F.col("l").alias("__l"), F.col("h").alias("__h"))
    gone = cut_lineage(few(told.distinct(), docs.count()))
    return docs.join(_small(gone), (_language() == F.col("__l")) & (F.md5(F.coalesce(_text(), F.lit(""))) == F.col("__h")), "left_anti")
