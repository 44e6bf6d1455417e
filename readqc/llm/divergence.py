"""Source divergence audit: the terms that set a source apart from its language, and how far sources of a language are from each other.

One pass over the texts counts terms by language and source, in dictionaries of bounded size that meet by an exchange on (lang, term). A language keeps
the terms of at least LEAST of its documents; what is left are postings: (lang, term, source, count). Probabilities are whole numbers, worked out with whole
numbers alone: p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)).

Terms of a group (lang, source): its terms fall into buckets by the group's count; a bucket's largest p and its smallest probability in the language
bound p - q of all its terms. Buckets are evaluated best first, in rounds over all groups at once, and a group is done when all bounds of unseen buckets are strictly
below its kth difference; ties at the kth place are so all seen.

Pairs of groups: postings meet in blocks of some TERMS terms by TILE sources of a language. A block is a dense array of probabilities, absent counts
included, from which the sums of all pairs of its sources come at once; terms that no source of the block has add a fixed amount. So a block gives a row a
pair, not one a term and pair.

Nulls: a null text, lang or source is ''. Rows of one doc_id are documents each. Ties go to the item that is first by its UTF-8 bytes. Texts of any length
are read whole, in pieces of PIECE bytes. A group without kept terms has no `term` rows, and a language without them has pairs of 0. An empty table has an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.ordered import numbered
from readqc.llm.shared import arrow, partitions, written

#: Documents of a language that a term must be in; what each count gains; the scale of probabilities; terms of a group that are reported.
LEAST, GAIN, SCALE_STEPS, TOP = 30, 5, (1000, 1000, 1000), 50
#: Entries that a task holds before it sends them; bytes of a text that are looked at together.
ENTRIES, PIECE = 200_000, 1 << 20
#: Buckets for each doubling of a count; how much more terms each round may evaluate.
FINE, FASTER = 4, 8
#: Terms and sources of a block of pairs.
TERMS, TILE = 1024, 256

#: Bytes of terms, in lower case; all others become blanks.
_TERM = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))


def terms_of(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about `size` bytes cut between terms."""
    clean = text.translate(_TERM)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + size)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _emitted(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        # a row without a term says that there is such a group
        terms = [b"", *n]
        for lo in range(0, len(terms), 50_000):
            own = terms[lo : lo + 50_000]
            columns = [pa.repeat(pa.scalar(lang), len(own)), pa.repeat(pa.scalar(source), len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, and numbers of documents, of terms by lang and source; a term may come in several rows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0
    for batch in batches:
        text, lang, source = batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, key in enumerate(zip(lang, source, strict=True)):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            before, seen = len(n), set()
            for own in terms_of(text[i].as_py(), PIECE):
                n.update(own)
                seen.update(own)
            docs.update(seen)
            entries += len(n) - before
            if entries >= ENTRIES:
                yield from _emitted(held)
                held, entries = {}, 0
    yield from _emitted(held)


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of kept terms, as a written table; `first` is 1 for one row of each (lang, term). A row with the term '' for each
    (lang, source)."""
    arrow(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(text).alias("text"), plain(lang).alias("lang"), plain(source).alias("source"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # one exchange serves the sums by source and those by language
    dealt = counted.repartition(partitions(docs), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    along = Window.partitionBy("lang", "term")
    mark = F.col("term") == ""
    held = dealt.select("*", F.sum("docs").over(along).alias("in_docs"), F.sum("n").over(along).alias("n_lang"), F.row_number().over(along.orderBy("source")).alias("k"))
    kept = held.where(mark | (F.col("in_docs") >= least))
    return written(kept.select("lang", "source", "term", "n", "n_lang", ((F.col("k") == 1) & ~mark).cast("long").alias("first")), "postings")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), digit by digit in longs: exact up to 9 * 10^15 words. 0 without kept terms."""
    over = F.nullif(total + GAIN * kept, F.lit(0).cast("long"))
    rest, out = count + GAIN, F.lit(0).cast("long")
    for step in SCALE_STEPS:
        out = out * step + F.call_function("div", rest * step, over)
        rest = (rest * step) % over
    return F.coalesce(out + 1, F.lit(0).cast("long"))


def _totals(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, total, place) and languages (lang, total_lang, kept): a row each."""
    groups = table.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = written(table.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.sum("first").alias("kept")), "langs")
    return written(numbered(groups, ["lang", "source"], "place"), "groups"), langs


def terms(table: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): of each group the `top` terms with the largest p - q > 0."""
    spark = table.sparkSession
    known = table.where("term <> ''").join(groups.select("lang", "source", "total"), ["lang", "source"]).join(langs, "lang")
    bucket = F.floor(FINE * F.log2("n")).cast("int")
    scored = known.select("lang", "source", "term", bucket.alias("bucket"), probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"), probability(F.col("n_lang"), F.col("total_lang"), F.col("kept")).alias("q"))
    scored = written(scored, "scored")
    group = ["lang", "source"]
    buckets = scored.groupBy(*group, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("many")).where("bound > 0")
    # a group has FINE buckets a doubling, some hundreds at most
    ahead = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    best = Window.partitionBy(*group).orderBy(F.col("value").desc(), "item")
    left, found, budget = written(buckets, "buckets"), None, top
    while not left.isEmpty():
        now = written(left.withColumn("now", F.coalesce(F.sum("many").over(ahead), F.lit(0)) < budget), "buckets")
        chosen = now.where("now").select(*group, "bucket")
        new = scored.join(chosen, [*group, "bucket"]).where("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        every = new if found is None else found.select(*new.columns).unionByName(new)
        found = written(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top), "found")
        kth = found.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        left = written(now.where("NOT now").join(kth, group, "left").where("kth IS NULL OR bound >= kth").drop("now", "kth"), "buckets")
        budget *= FASTER
    if found is None:
        return spark.createDataFrame([], "lang string, source string, item string, value long, rank int")
    return found.select(*group, "item", "value", "rank")


def _block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all pairs of sources of a block over its terms, and how many terms these are. Rows without a term give the sources and what they have where they
    lack a term."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    term, side, place, p = (table.column(c) for c in ("term", "side", "place", "p"))
    side, place, p = side.to_numpy(), place.to_numpy(), p.to_numpy()
    is_mark = np.asarray(term.is_null())
    order = np.argsort(place[is_mark], kind="stable")
    places, sides, base = place[is_mark][order], side[is_mark][order], p[is_mark][order]
    codes = term.combine_chunks().dictionary_encode()
    many = len(codes.dictionary)
    dense = np.repeat(base[None, :], many, axis=0)
    own = ~is_mark
    dense[np.asarray(codes.indices.fill_null(0))[own], np.searchsorted(places, place[own])] = p[own]
    ones, others = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)  # side 2: a block of sources with itself
    right = dense[:, others]
    out = [np.zeros(0, np.int64)] * 3
    for i in ones.tolist():
        sums = np.abs(right - dense[:, i : i + 1]).sum(0)
        later = places[others] > places[i]
        out = [np.concatenate([a, b]) for a, b in zip(out, (np.full(int(later.sum()), places[i]), places[others][later], sums[later]), strict=True)]
    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), pa.array(np.full(len(out[0]), many))], ["a", "b", "value", "seen"])


def pairs(table: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): of each group all other sources of its language by the sum of differences over all kept terms."""
    tiled = groups.join(langs.select("lang", "kept"), "lang").withColumn("tile", F.floor(F.col("place") / TILE))
    tiles = tiled.select("lang", "tile").distinct()
    other = tiles.select("lang", F.col("tile").alias("tile_b"))
    both = tiles.select("lang", F.col("tile").alias("tile_a")).join(other, "lang").where("tile_a <= tile_b")
    # for each tile the pairs of tiles that it is in: 0 and 1 are the first and the second, 2 is both
    ends = both.select("lang", F.explode(F.when(F.col("tile_a") == F.col("tile_b"), F.array(F.struct(F.col("tile_a").alias("tile"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("tile_a").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("tile_b").alias("tile"), F.lit(1).alias("side"))))).alias("end"), "tile_a", "tile_b").select("lang", "end.*", "tile_a", "tile_b")
    pieces = F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1).cast("long"))
    sources = tiled.select("lang", "source", "total", "kept", "place", "tile", pieces.alias("pieces"))
    base = probability(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    marks = sources.select("lang", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(None).cast("string").alias("term"), "place", base.alias("p"))
    known = table.where("term <> ''").join(sources, ["lang", "source"])
    known = known.select("lang", "tile", F.pmod(F.xxhash64("term"), F.col("pieces")).alias("piece"), "term", "place", probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    dealt = marks.unionByName(known).join(ends, ["lang", "tile"])
    sums = dealt.select("lang", "tile_a", "tile_b", "piece", "term", "side", "place", "p").groupBy("lang", "tile_a", "tile_b", "piece").applyInArrow(_block, "a long, b long, value long, seen long")
    whole = sums.groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    of = sources.select("place", "lang", "source", "kept", base.alias("base"))
    names = whole.join(of.toDF("a", "lang", "source", "kept", "base_a"), "a").join(of.select("place", "source", "base").toDF("b", "source_b", "base_b"), "b")
    value = F.col("value") + (F.col("kept") - F.col("seen")) * F.abs(F.col("base_a") - F.col("base_b"))
    ways = F.array(F.struct(F.col("source").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source").alias("item")))
    rows = names.select("lang", value.alias("value"), F.explode(ways).alias("way")).select("lang", "way.*", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the two parts, `term` and `pair`."""
    table = postings(docs, text, lang, source, least)
    groups, langs = _totals(table)
    parts = {"term": terms(table, groups, langs, top), "pair": pairs(table, groups, langs)}
    term, pair = (df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for part, df in parts.items())
    return term.unionByName(pair)


def audit_sql(table: str = "documents", least: int = LEAST, top: int = TOP) -> str:
    """The same in DuckDB's SQL: every kept term in every group."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table}),
words AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {least}),
langs AS (SELECT d.lang, coalesce(any_value(v), 0) AS v, coalesce(any_value(total_lang), 0) AS total_lang FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang) k USING (lang) GROUP BY d.lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) c USING (lang, source) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format(n="coalesce(c.n, 0)", total="total")} AS p, {p.format(n="n_lang", total="total_lang")} AS q
  FROM groups g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM cells WHERE n > 0 AND p > q),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value, row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source) AS rank
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT * FROM term WHERE rank <= {top} UNION ALL SELECT * FROM pair)"""
