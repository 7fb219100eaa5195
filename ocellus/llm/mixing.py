"""Mixing sources to target weights, in DataFrame operations only.

Documents of a source are dealt into blocks of about ``block_words`` words by a hash, anew for each pass over the source. What a
source must give is then an exact quota of blocks: all blocks of its whole passes, and as many of its last, partial pass as reach
the target; in the block where the target falls, documents are taken from the longest to the shortest, each if it still fits. A
splitting tree divides the quotas among output shards: each node gives its left half an exact share of its blocks, composed by a multivariate
hypergeometric draw (one hypergeometric draw per source, each on what the earlier ones left), down to single shards. A shard owns
a range of each source's permuted blocks, disjoint from every other shard's, and shuffles its documents locally.

What is known of the sources is broadcast while there are at most ``BROADCAST_ROWS`` of them, and the shards' ranges while there are
at most 40 times as many; beyond that the ranges are joined by source and group of block draws, which no hot source shares as a
key. The sources themselves, a few numbers each, are put in order by one task.

All of it is deterministic: hashes of contents stand in for random numbers, so reruns and lost executors change nothing.

Defined cases: a null or wordless text has size 0 and takes part in no draw's words (it is taken as often as its block); a null
source is a source of its own, last in order; repeated rows are drawn alike; an empty table, or one without words, gives targets
of 0; input columns may have any names (they travel in a struct).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.runtime import cut_lineage, few

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's size as a share of the input's.
SHARE = 1.5
#: A source is taken this often at most.
MOST = 2
BLOCK_WORDS = 16_384
#: Blocks also hold no more documents than this on average, so that empty texts can't pile up.
BLOCK_DOCS = 4_096
SHARD_WORDS = 4_000_000
#: Most rows of the table of sources for which it is broadcast; beyond it, the join is an ordinary one. Ranges of draws: see above.
BROADCAST_ROWS, BROADCAST_RANGES = 20_000, 800_000
_GROUP = 1_024


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hash(*parts: Column) -> Column:
    """60 bits of an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _uniform(*parts: Column) -> Column:
    return (_hash(*parts).cast("double") + 0.5) / float(2**60)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked`` ones, by inverting the distribution at ``u``.

    Weights are worked out from the mode to either side as far as 12 standard deviations, beyond which nothing is left in
    double precision; walking them from the low end finds the answer. Cost: 24 standard deviations.
    """

    def up(k: Column, p: Column) -> Column:
        """Weight of k + 1 by that of k."""
        return ((p["marked"] - k) * (p["drawn"] - k)).cast("double") / ((k + 1) * (p["total"] - p["marked"] - p["drawn"] + k + 1)).cast("double")

    def bounds(p: Column) -> Column:
        t, m, d = (p[c].cast("double") for c in ("total", "marked", "drawn"))
        least = F.greatest(F.lit(0).cast("long"), p["drawn"] + p["marked"] - p["total"])
        most = F.least(p["drawn"], p["marked"])
        spread = F.sqrt(d * (m / t) * (1 - m / t) * (t - d) / F.greatest(t - 1, F.lit(1.0)))
        mode = F.least(F.greatest(F.floor((d + 1) * (m + 1) / (t + 2)), least), most)
        reach = F.ceil(12 * spread) + 8
        return F.struct(p["total"].alias("total"), p["marked"].alias("marked"), p["drawn"].alias("drawn"), F.greatest(least, mode - reach).alias("low"), F.least(most, mode + reach).alias("high"), mode.alias("mode"))

    def steps(a: Column, b: Column, by: int = 1) -> Column:
        """a, a+by, ... before b; none if a is at b."""
        return F.when(a == b, F.array().cast("array<bigint>")).otherwise(F.sequence(a, b - by, F.lit(by).cast("long")))

    def walk(q: Column) -> Column:
        zero, one = F.lit(0.0), F.lit(1.0)
        above = F.aggregate(steps(q["mode"], q["high"]), F.struct(one.alias("w"), zero.alias("s")), lambda a, k: _let(a["w"] * up(k, q), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))), lambda a: a["s"])
        below = F.aggregate(steps(q["mode"], q["low"], -1), F.struct(one.alias("w"), zero.alias("s")), lambda a, k: _let(a["w"] / up(k - 1, q), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))))
        start = lambda t: F.struct(t["w"].alias("w"), t["w"].alias("c"), (F.when(t["w"] >= t["goal"], q["low"]).otherwise(F.lit(-1).cast("long"))).alias("k"))
        found = lambda t: F.aggregate(steps(q["low"], q["high"]), start(t), lambda a, k: _let(a["w"] * up(k, q), lambda w: F.struct(w.alias("w"), (a["c"] + w).alias("c"), F.when((a["k"] < 0) & (a["c"] + w >= t["goal"]), k + 1).otherwise(a["k"]).alias("k"))), lambda a: F.when(a["k"] < 0, q["high"]).otherwise(a["k"]))
        return _let(F.struct(above.alias("a"), below.alias("b")), lambda s: _let(F.struct(s["b"]["w"].alias("w"), (u * (1 + s["a"] + s["b"]["s"])).alias("goal")), found))

    given = F.struct(total.cast("long").alias("total"), marked.cast("long").alias("marked"), drawn.cast("long").alias("drawn"))
    return F.when((marked <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(marked >= total, drawn.cast("long")).otherwise(_let(_let(given, bounds), walk))


def split_tree(quotas: DataFrame, shards: int, seed: str = "mix") -> DataFrame:
    """One row of ``quotas`` (quota: array<long>, blocks per source) becomes one per shard: shard, first (array: where the shard's
    range of each source's blocks begins) and quota (how many it has)."""
    zero = F.transform("quota", lambda _: F.lit(0).cast("long"))
    nodes = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quota", zero.alias("first"))
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda a, q: a + q)
        mid = F.expr("(lo + hi) div 2")

        def draw(acc: Column, x: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("lo").cast("string"), F.col("hi").cast("string"), F.size(acc["out"]).cast("string"))
            return _let(hypergeometric(acc["total"], x, acc["drawn"], u), lambda k: F.struct((acc["total"] - x).alias("total"), (acc["drawn"] - k).alias("drawn"), F.array_append(acc["out"], k).alias("out")))

        start = F.struct(F.col("total").alias("total"), F.expr("total * (mid - lo) div (hi - lo)").alias("drawn"), F.array().cast("array<bigint>").alias("out"))
        told = nodes.withColumn("total", total).withColumn("mid", mid)
        told = told.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("quota", start, draw, lambda a: a["out"])))
        low = F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("left").alias("quota"), F.col("first"))
        high = F.struct(F.col("mid").alias("lo"), F.col("hi"), F.zip_with("quota", "left", lambda q, k: q - k).alias("quota"), F.zip_with("first", "left", lambda f, k: f + k).alias("first"))
        own = F.struct("lo", "hi", "quota", "first")
        nodes = told.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, F.array(low, high)).otherwise(F.array(own))).alias("x")).select("x.*")
    return nodes.select(F.col("lo").alias("shard"), "first", "quota")


def _sources(sized: DataFrame) -> DataFrame:
    """One row per source: s, weight, words, docs, target, whole (passes over all of it), rest (words of the partial pass), blocks.

    Targets are those of the repeated sharing: below a level t, sources that would get more than they may are held at
    ``MOST`` times their words, all others get t times their weight. In order of (most they may get / weight), the held ones
    come first, so running sums give the level at every source.
    """
    found = sized.groupBy("s").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy("s"))
    weigh = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = found.withColumn("rank", rank).withColumn("weight", weigh).withColumn("most", MOST * F.col("words")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    told = ranked.withColumn("budget", SHARE * F.sum("words").over(every)).withColumn("level", (F.col("budget") - before) / after)
    told = told.withColumn("held", F.col("ratio") <= F.col("level"))
    told = told.withColumn("at", F.min(F.when(~F.col("held"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    target = F.when(F.col("held"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("at"))
    told = told.withColumn("target", target)
    whole = F.when(F.col("words") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.col("words")), F.lit(MOST)))
    told = told.withColumn("whole", whole.cast("long")).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("words"), F.lit(0.0)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / BLOCK_WORDS), F.ceil(F.col("docs") / BLOCK_DOCS))
    return told.withColumn("blocks", blocks.cast("long")).select("s", "rank", "words", "docs", "target", "whole", "rest", "blocks")


def _with_sources(df: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    return df.join(F.broadcast(sources) if rows <= BROADCAST_ROWS else sources, "s")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` as: row (struct of all columns), s (its source, in order and never null), size, key (a hash of id and text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    s = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), s.alias("s"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))


def _block(part: Column) -> Column:
    """Block of a document in pass ``part`` over its source."""
    return F.pmod(_hash(part.cast("string"), F.col("key")), F.col("blocks"))


def plan(docs: DataFrame) -> tuple[DataFrame, int]:
    """The sources with ``last`` (full blocks of the partial pass), ``chosen`` (keys taken of the block after them, or null) and
    ``quota`` (block draws); and the number of sources."""
    narrow = cut_lineage(sized(docs).select("s", "size", "key"))
    sources = cut_lineage(_sources(narrow))
    rows = sources.count()
    kept = lambda df: cut_lineage(few(df, 100 * rows))  # noqa: E731  a source is more work than a document
    known = _with_sources(narrow, sources, rows).where("rest > 0").withColumn("b", _block(F.col("whole")))
    blocks = known.groupBy("s", "b").agg(F.sum("size").alias("n"), F.first("rest").alias("rest")).withColumn("g", F.expr(f"b div {_GROUP}"))
    groups = blocks.groupBy("s", "g").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n").over(Window.partitionBy("s", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    ends = blocks.withColumn("within", within).join(groups.select("s", "g", before.alias("before")), ["s", "g"]).withColumn("end", F.col("before") + F.col("within"))
    crossing = kept(ends.where("end > rest").groupBy("s").agg(F.min_by("b", "end").alias("b"), F.min_by(F.col("rest") - F.col("end") + F.col("n"), "end").alias("bound")))
    # The one block of each source in which the target falls: from its longest document to its shortest, take what still fits. Rows
    # with equal keys are equal documents and share a decision.
    edge = known.select("s", "b", "size", "key").where("size > 0").join(F.broadcast(crossing) if rows <= BROADCAST_ROWS else crossing, ["s", "b"])
    same = edge.groupBy("s", "key").agg(F.sum("size").alias("n"), F.first("bound").alias("bound"))
    listed = same.groupBy("s").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))).alias("docs"), F.first("bound").alias("bound"))
    start = F.struct(F.col("bound").cast("double").alias("left"), F.array().cast("array<string>").alias("keys"))
    fit = lambda a, x: F.when(-x["n"] <= a["left"], F.struct((a["left"] + x["n"]).alias("left"), F.array_append(a["keys"], x["key"]).alias("keys"))).otherwise(a)
    taken = listed.select("s", F.aggregate("docs", start, fit, lambda a: a["keys"]).alias("chosen"))
    told = sources.join(crossing.select("s", F.col("b").alias("last")), "s", "left").join(taken, "s", "left")
    told = told.withColumn("last", F.coalesce("last", F.when(F.col("rest") > 0, F.col("blocks")).otherwise(F.lit(0))))
    told = told.withColumn("chosen", F.when(F.size("chosen") > 0, F.col("chosen")))
    quota = F.col("whole") * F.col("blocks") + F.col("last") + F.col("chosen").isNotNull().cast("long")
    return kept(told.withColumn("quota", quota)), rows


def mix(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs`` as: row (struct), size, source_size, target, taken (words) and draws (array of struct of pass, block
    and shard; empty if the mix leaves the document out)."""
    sources, rows = plan(docs)
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, math.ceil(words / shard_words))
    leaves = split_tree(sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quota")), shards)
    ranges = leaves.select("shard", F.posexplode(F.arrays_zip("first", "quota")).alias("i", "own")).select((F.col("i") + 1).alias("rank"), "shard", F.col("own.first").alias("first"), (F.col("own.first") + F.col("own.quota")).alias("end"))
    near = rows * shards <= BROADCAST_RANGES and rows <= BROADCAST_ROWS
    if near:
        # Of each source, where each shard's range of block draws ends: a shard is found by how many ranges end at or before a draw.
        ends = F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"])
        sources = cut_lineage(few(sources.join(ranges.groupBy("rank").agg(ends.alias("ends")), "rank"), 100 * rows))
    told = _with_sources(sized(docs), sources, rows)
    last = _block(F.col("whole"))
    extra = (F.col("rest") > 0) & ((last < F.col("last")) | ((last == F.col("last")) & F.coalesce(F.array_contains("chosen", F.col("key")), F.lit(False))))
    told = told.withColumn("times", F.col("whole") + F.when(extra, 1).otherwise(0)).withColumn("taken", F.col("size") * F.col("times"))
    unit = lambda p: p * F.col("blocks") + _block(p)
    if not near:
        told = _found_by_join(told, cut_lineage(ranges), unit)
    passes = F.when(F.col("times") > 0, F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).otherwise(F.array().cast("array<bigint>"))

    def shard_of(unit: Column) -> Column:
        """By halving: the first range that ends after ``unit``."""
        start = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(shards - 1).cast("long").alias("hi"))
        halve = lambda a, _: _let(F.floor((a["lo"] + a["hi"]) / 2), lambda m: F.when(F.element_at(F.col("ends"), (m + 1).cast("int")) > unit, F.struct(a["lo"].alias("lo"), F.greatest(m, a["lo"]).alias("hi"))).otherwise(F.struct(F.least(m + 1, a["hi"]).alias("lo"), a["hi"].alias("hi"))))
        return F.aggregate(F.sequence(F.lit(0), F.lit(max(1, shards).bit_length())), start, halve, lambda a: a["lo"])

    def draw(p: Column) -> Column:
        shard = shard_of(unit(p)) if near else F.element_at("shards", (p + 1).cast("int"))
        return F.struct(p.alias("pass"), _block(p).alias("block"), shard.alias("shard"))

    return told.select("row", "size", F.col("words").alias("source_size"), "target", "taken", "times", F.transform(passes, draw).alias("draws"))


def _found_by_join(told: DataFrame, ranges: DataFrame, unit) -> DataFrame:
    """``told`` with shards (an array by pass), from ``ranges`` (rank of the source, shard, first, end). Both sides meet by rank and group
    of _GROUP draws, of which even a hot source has many."""
    group = lambda x: F.floor(x / _GROUP)
    spread = ranges.where("end > first").withColumn("g", F.explode(F.sequence(group(F.col("first")), group(F.col("end") - 1))))
    for p in range(MOST):
        of = spread.select(F.col("rank").alias(f"r{p}"), F.col("g").alias(f"g{p}"), F.col("first").alias(f"a{p}"), F.col("end").alias(f"z{p}"), F.col("shard").alias(f"shard{p}"))
        told = told.withColumn(f"u{p}", F.when(F.col("times") > p, unit(F.lit(p).cast("long"))))
        inside = (F.col(f"u{p}") >= F.col(f"a{p}")) & (F.col(f"u{p}") < F.col(f"z{p}"))
        told = told.join(of, (F.col("rank") == F.col(f"r{p}")) & (group(F.col(f"u{p}")) == F.col(f"g{p}")) & inside, "left")
    return told.withColumn("shards", F.array(*(f"shard{p}" for p in range(MOST))))


def mixed_rows(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, dealt by shard and shuffled within each."""
    drawn = mix(docs, shard_words).select("row", F.explode("draws").alias("draw"))
    order = F.md5(F.concat_ws("|", F.col("draw.pass").cast("string"), F.col("row.doc_id").cast("string"), F.xxhash64("row.text").cast("string")))
    return drawn.repartition(F.col("draw.shard")).sortWithinPartitions(F.col("draw.shard"), order).select("row.*")
