"""Token counts of whole texts, from pre-token frequencies.

Every distinct pre-token is tokenised once; documents only contribute frequencies, and no token id is kept. Frequent pre-tokens
sit in a broadcast table of at most ``head_size`` entries and HEAD_BYTES bytes, a proven bound; all others are shuffled by
pre-token, counted there once each, and summed per document. A pre-token of a thousandth of the documents is in the table's sample
some twenty times, so what is shuffled has no hot key. Those longer than LONG characters, hardly ever the same twice, are counted
where they stand, once a batch, and never travel. Which pre-tokens are in the table changes the speed, never a result.

Defined cases: a null text is empty (0 bytes, 0 tokens); repeated rows give one result row each; a null ``doc_id`` stays null;
columns besides ``doc_id`` and ``text`` are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm.batches import slices
from ocellus.llm.pretokens import split
from ocellus.runtime import few

HEAD_SIZE = 262_144
HEAD_BYTES = 16 << 20
#: Pre-tokens of more characters are neither shuffled nor in the table.
LONG = 256
#: Bytes of texts in a batch, one text at least.
BATCH_BYTES = 8 << 20
#: Documents looked at to choose the table's entries.
HEAD_DOCS = 20_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _special(path: str):
    """Splits a text at the tokenizer's added tokens, which the library looks for before anything else."""
    import re

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError("this operator needs a byte-level tokenizer without normaliser, prefix space or stripping added tokens")
    names = sorted((a["content"] for a in added), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None


def frequencies(text: str, special) -> tuple[Counter, int]:
    """Pre-token frequencies of one text, and how many added tokens it holds."""
    if special is None or not special.search(text):
        return Counter(split(text)), 0
    parts = special.split(text)
    found: Counter = Counter()
    for part in parts:
        found.update(split(part))
    return found, len(parts) - 1


def pieces(words: list[str], path: str) -> list[int]:
    """How many tokens each pre-token becomes."""
    return [len(e.ids) for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)] if words else []


def _head(docs: DataFrame, total: int, path: str, head_size: int) -> dict[str, int]:
    """Frequent short pre-tokens of ``total`` rows with their counts. Only a choice of what to keep at hand: results don't depend on it."""
    some = docs.select("text").sample(min(1.0, HEAD_DOCS / max(total, 1)), seed=7)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, seen = _special(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(frequencies(text or "", special)[0])
        top = [(w, n) for w, n in seen.most_common(head_size) if len(w) <= LONG]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    seen = some.mapInArrow(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = seen.where("n > 1").orderBy(F.desc("n"), "piece").limit(head_size).select("piece").collect()
    size = accumulate(len(r[0].encode()) for r in rows)
    words = [r[0] for r, n in zip(rows, size, strict=True) if n <= HEAD_BYTES]
    return dict(zip(words, pieces(words, path), strict=True))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, head_size: int = HEAD_SIZE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    table = spark.sparkContext.broadcast(_head(docs, total, tokenizer_path, head_size))
    tag = F.xxhash64("text")  # rows are told apart by id and a hash of the text; equal rows are counted
    names = ["doc_id", "tag", "piece", "freq", "n_bytes", "tokens", "copies"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    ddl = "doc_id long, tag long, piece string, freq long, n_bytes long, tokens long, copies long"

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, at_hand = _special(tokenizer_path), table.value
        for batch in slices(batches, BATCH_BYTES):
            ids, tags, texts = (batch.column(i).to_pylist() for i in range(3))
            rows: list[tuple] = []
            long: dict[str, int] = {}
            for doc_id, mark, text in zip(ids, tags, texts, strict=True):
                found, tokens = frequencies(text or "", special)
                for piece, freq in found.items():
                    n = at_hand.get(piece)
                    if n is None and len(piece) > LONG:
                        n = long.get(piece)
                        if n is None:
                            n = long[piece] = pieces([piece], tokenizer_path)[0]
                    if n is None:
                        rows.append((doc_id, mark, piece, freq, 0, 0, 0))
                    else:
                        tokens += n * freq
                rows.append((doc_id, mark, None, 0, len((text or "").encode()), tokens, 1))
                if len(rows) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_n = None, 0  # rows come sorted by piece: what a batch ends with may go on in the next one
        for batch in batches:
            words = batch.column(2).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            fresh = [w for w in distinct if w != last]
            counts = dict(zip(fresh, pieces(fresh, tokenizer_path), strict=True))
            if last is not None:
                counts.setdefault(last, last_n)
            index, freq, tokens = words.indices.to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist()
            tokens = [t if i is None else t + f * counts[distinct[i]] for i, f, t in zip(index, freq, tokens, strict=True)]
            if distinct:
                last, last_n = distinct[-1], counts[distinct[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(tokens, pa.int64()), batch.column(6)], ["doc_id", "tag", "n_bytes", "tokens", "copies"])

    rows = docs.select("doc_id", tag.alias("tag"), "text").mapInArrow(known, ddl)
    dealt = rows.repartition(F.when(F.col("piece").isNull(), F.xxhash64("doc_id", "tag")).otherwise(F.xxhash64("piece"))).sortWithinPartitions("piece")
    parts = dealt.mapInArrow(resolve, "doc_id long, tag long, n_bytes long, tokens long, copies long")
    sums = few(parts.groupBy("doc_id", "tag").agg(*(F.sum(c).alias(c) for c in ("n_bytes", "tokens", "copies"))), max(total, size / 2048))
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    n = F.expr("tokens div copies")
    return each.select("doc_id", F.expr("n_bytes div copies").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit"))
