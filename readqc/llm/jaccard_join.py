"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles. All sets share one order of shingles: rare ones first, by
a count sketch that grows with the input up to SLOTS_MOST, then by hash; a slot's level goes up to 2 ** 31, so that also in a sketch that is full
the common shingles stand out and come last. Two sets that overlap enough share a shingle among the first
n - ceil(t n) + 1 of each (the prefix). Documents with identical prefix and size form one group; groups that
share a prefix shingle are paired, filtered by size and by the places of that shingle, then expanded
to members and verified on the whole sets. A set's identity is a digest of 16 bytes.

A shingle that the sketch counts 2 ** HOT times or more is dealt over parts: its postings go to several buckets, and its side of a join is
split by part while the few on the other side go to each, so that no task holds all of it.

What is asked for is which documents hang together, so a pair inside one component need not be looked at.
Rounds of stars (some groups of a shingle's bucket against all others) merge large groups of copies with
work in proportion to the postings; a last round takes every remaining pair of different
components. No pair is dropped unseen and no group of copies is expanded into all pairs.

Nulls: a null text is an empty text, its set is empty, it links with nothing; a null doc_id gives a row
with a null component. Fewer words than the shingle: the whole sequence is the one shingle. Repeated rows
and copies are one set. An empty table gives no rows. Ties: a similarity of just the threshold links. Texts of any length are worked out whole,
one beyond PIECE bytes by itself. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm import textkernel as K
from readqc.llm.components import components
from readqc.llm.fixed import summed
from readqc.llm.shared import arrow, few_tasks, partitions, release, texts, written

#: Words of a shingle; similarity in hundredths; rounds of stars at most, hubs in the first one and in each of the others.
WIDTH, PERCENT, STARS, FIRST_HUBS, HUBS = 5, 75, 3, 4, 16
#: Slots of the sketch: so many for each split of the input, within these bounds. A worker holds a byte a slot, and four while counting.
SLOTS_SPLIT, SLOTS_LEAST, SLOTS_MOST = 1 << 17, 1 << 22, 1 << 24
#: Bits of a shingle's key that hold its level; from which level on it is dealt over parts, which hold some 2 ** (HOT - 1) postings each.
LEVEL_BITS, HOT = 5, 12
#: Upper bits of a key that postings carry. Shingles that share them are taken for one there, which makes candidates and loses none.
POSTED_BITS = 48
#: Bits for each document that is looked for, least and most bits of that filter.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 25
#: Words of the outline that a join's condition looks at.
FOLD = 4
#: Bytes of text at once; postings packed at once; postings of a shingle that are compared for a partner.
PIECE, POSTINGS, NEIGHBOURS = 2 << 20, 1_000_000, 24
U = np.uint64


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int) -> Iterator[np.ndarray]:
    """Hashes of each document's shingles, with repeats."""
    w = K.words(column)
    grams = K.gram_hashes(w.hashes, width)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield grams[a : b - width + 1]
        elif b > a:
            yield np.array([K.sequence_hash(w.hashes[a:b])], U)
        else:
            yield np.zeros(0, U)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> U(40)).astype(np.int64) & (slots - 1)


def sketch(docs: DataFrame, width: int, slots: int) -> np.ndarray:
    """For each slot of shingle hashes the power of two that its count over all documents reaches (0 to 31)."""

    def count(batches, out):
        for piece in K.chunks(batches, "text", PIECE):
            sets = [np.unique(s) for s in shingle_sets(piece["text"], width)]
            np.add.at(out, _slot(np.concatenate(sets), slots), np.uint32(1)) if sets else None

    # large counts of one task are cut, as only their magnitude tells
    return summed(docs, count, slots, np.uint8, lambda x: np.minimum(31, np.floor(np.log2(np.maximum(x, 1)))).astype(np.uint8))


def ordered(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The distinct shingles in the common order, as keys of level and hash."""
    return np.unique((levels[_slot(h, len(levels))].astype(U) << U(64 - LEVEL_BITS)) | (h >> U(LEVEL_BITS)))


def parts_of(tokens: np.ndarray, hot: int) -> np.ndarray:
    """Over how many parts each shingle is dealt: one below the level `hot`."""
    level = (tokens >> U(64 - LEVEL_BITS)).astype(np.int64)
    return np.left_shift(1, np.maximum(level - (hot - 1), 0))


def part_of(owner: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of a posting, by its prefix."""
    return ((K.mix(owner.astype(np.int64).view(U)) >> U(32)).astype(np.int64) % parts).astype(np.int64)


def bits(s: np.ndarray) -> np.ndarray:
    """A set's outline: a bit for each remainder that a shingle has, two to four times as many bits as shingles, in 64-bit words."""
    size = 1 << max(8, int(2 * len(s)).bit_length())
    out = np.zeros(size, np.uint8)
    out[(s & U(size - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def fold(outline: np.ndarray, words: int) -> np.ndarray:
    """An outline laid over itself down to so many words (both are powers of two): that of the same set with fewer bits."""
    return np.bitwise_or.reduce(outline.reshape(-1, words), axis=0)


def margin(a: np.ndarray, b: np.ndarray, n1: int, n2: int, percent: int) -> float:
    """By how much two outlines leave room for a link, negative if they don't: a bit that only one set has stands for a shingle at least
    that the other lacks."""
    words = min(len(a), len(b))
    a, b = fold(a, words), fold(b, words)
    lacks = [int(np.bitwise_count(x & ~y).sum()) for x, y in ((a, b), (b, a))]
    return ((100 + percent) * min(n1 - lacks[0], n2 - lacks[1]) - percent * (n1 + n2)) / (n1 + n2)


def folds_allow(a: str, b: str, n1, n2, percent: int):
    """The same for columns of outlines of FOLD words; few enough for the condition of a join to stay small code."""

    def lacks(x, y):
        return functools.reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}.f{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}.f{i}")))) for i in range(FOLD)))

    return (100 + percent) * F.least(n1 - lacks(a, b), n2 - lacks(b, a)) >= percent * (n1 + n2)


def likely_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(u, v, margin) of those of (u, v) whose outlines allow a link."""

    def run(batches):
        for batch in batches:
            n1, b1, n2, b2 = (batch.column(c).to_pylist() for c in ("n1", "b1", "n2", "b2"))
            room = np.array([margin(np.frombuffer(x, U), np.frombuffer(y, U), m, n, percent) for m, x, n, y in zip(n1, b1, n2, b2, strict=True)], float)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(room)], ["u", "v", "margin"]).filter(pa.array(room >= 0))

    outline = members.select("node", "n", "bits")
    return pairs.join(outline.toDF("u", "n1", "b1"), "u").join(outline.toDF("v", "n2", "b2"), "v").select("u", "v", "n1", "b1", "n2", "b2").mapInArrow(run, "u binary, v binary, margin double")


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def _long(b: bytes) -> int:
    return int.from_bytes(b[:8], "little", signed=True)


def signatures(docs: DataFrame, levels, width: int, percent: int, buckets: int, hot: int = HOT) -> DataFrame:
    """In one pass a row per document (doc_id, n, prefix, node: hash of prefix with size, and digest of the whole set) and rows of
    packed postings: for a bucket of shingles, which prefixes hold which, and where. Prefixes of one size whose hashes are equal by chance
    form one group, of which nothing is lost: all of their postings stay, and their members are verified as any others."""

    def run(batches):
        book = levels.value
        names = ["doc_id", "n", "prefix", "node", "bits", "fold", "bucket", "tokens", "owner", "place", "owners", "sizes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 5]
        held: list[tuple[np.ndarray, int]] = []
        own: dict[bytes, int] = {}
        sizes: list[int] = []
        waiting = 0

        def postings():
            if not held:
                return
            tokens = np.concatenate([x for x, _ in held]) & ~U((1 << (64 - POSTED_BITS)) - 1)
            owner = np.repeat(np.array([o for _, o in held], np.uint32), [len(x) for x, _ in held])
            place = np.concatenate([np.arange(len(x), dtype=np.uint32) for x, _ in held])
            keys, ns = np.array([_long(k) for k in own], np.int64), np.array(sizes, np.uint32)
            part = part_of(keys[owner], parts_of(tokens, hot))
            bucket = (K.mix(K.mix(tokens) + part.astype(U)) % U(buckets)).astype(np.int32)
            order = np.lexsort((tokens, bucket))
            tokens, owner, place, bucket = tokens[order], owner[order], place[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if b > a:
                    used, local = np.unique(owner[a:b], return_inverse=True)
                    row = [[None]] * 6 + [[i], [K.pack_sorted(tokens[a:b])], [K.planes(local.astype(np.uint32))], [K.planes(place[a:b])], [keys[used].tobytes()], [K.planes(ns[used])]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for piece in K.chunks(batches, "text", PIECE):
            n, prefix, node, outline = [], [], [], []
            for key, s in zip(piece["doc_id"].to_pylist(), shingle_sets(piece["text"], width), strict=True):
                s = ordered(s, book)
                n.append(len(s))
                outline.append(bits(s))
                if not len(s):
                    prefix.append(None)
                    node.append(None)
                    continue
                head = s[: prefix_length(len(s), percent)]
                p = K.digest(np.append(head, U(len(s))))
                prefix.append(_long(p))
                node.append(K.digest(s))
                if p not in own and key is not None:
                    own[p] = len(own)
                    sizes.append(len(s))
                    held.append((head, own[p]))
                    waiting += len(head)
            folds = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([fold(x, FOLD) for x in outline])), FOLD).cast(pa.list_(pa.int64()))
            row = [piece["doc_id"].combine_chunks(), n, prefix, node, [x.tobytes() for x in outline], folds, *[[None] * len(n)] * 6]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)
            if waiting >= POSTINGS:
                yield from postings()
                held.clear(), own.clear(), sizes.clear()
                waiting = 0
        yield from postings()

    return docs.mapInArrow(run, "doc_id long, n long, prefix long, node binary, bits binary, fold array<long>, bucket int, tokens binary, owner binary, place binary, owners binary, sizes binary")


def may_link(n1, i1, n2, i2, percent: int):
    """Whether sets of n1 and n2 shingles may link, whose first common shingle is at places i1 and i2: the sizes allow it, and
    what is left from those places on. For numbers, arrays and columns."""
    small = 100 * n1 >= percent * n2
    large = 100 * n2 >= percent * n1
    least = percent * (n1 + n2)
    return small & large & ((100 + percent) * (n1 - i1) >= least) & ((100 + percent) * (n2 - i2) >= least)


def shared_postings(packed: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """(token, part, parts, prefix, n, place) of the shingles that two prefixes or more hold. Postings without any partner that the filter
    lets through are left out, and of shingles that the same prefixes hold the first in the order stands for all, as it has the
    least places. A bucket's share of postings is bounded, as buckets are many and filled by hash, and hot shingles are dealt over
    several; their postings all stay, since no bucket sees all of them."""

    def merge(key, batches):
        tokens, owner, n, place = [], [], [], []
        for batch in batches:
            for t, o, p, owners, sizes in zip(*(batch.column(c).to_pylist() for c in ("tokens", "owner", "place", "owners", "sizes")), strict=True):
                local = K.unplanes(o, np.uint32)
                tokens.append(K.unpack_sorted(t))
                owner.append(np.frombuffer(owners, np.int64)[local])
                n.append(K.unplanes(sizes, np.uint32)[local].astype(np.int64))
                place.append(K.unplanes(p, np.uint32))
        tokens, owner, n, place = (np.concatenate(x) for x in (tokens, owner, n, place))
        parts = parts_of(tokens, hot)
        dealt = parts > 1
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        same = t[1:] == t[:-1]
        order = order[np.append(False, same) | np.append(same, False) | dealt[order]]  # of shingles met twice
        order = order[np.lexsort((place[order], n[order], owner[order], tokens[order]))]
        columns = [x[order] for x in (tokens, owner, n)]
        # a posting for each prefix, at its least place, which rules out least
        fresh = np.append(True, np.any([x[1:] != x[:-1] for x in columns], axis=0))[: len(order)]
        order, t = order[fresh], columns[0][fresh]
        same = t[1:] == t[:-1]
        order = order[(np.append(False, same) | np.append(same, False))[: len(t)] | dealt[order]]
        order = order[np.lexsort((n[order], tokens[order]))]
        t, size, at = tokens[order], n[order], place[order].astype(np.int64)
        keep = dealt[order]
        for d in range(1, min(NEIGHBOURS, len(order) - 1) + 1):
            same = t[d:] == t[:-d]
            if not same.any():
                break
            good = same & may_link(size[d:], at[d:], size[:-d], at[:-d], percent)
            keep[d:] |= good
            keep[:-d] |= good
        else:
            if len(order) > NEIGHBOURS + 1:  # longer lists than were compared stay whole
                _, back, many = np.unique(t, return_inverse=True, return_counts=True)
                keep |= many[back] > NEIGHBOURS + 1
        order = order[keep]
        if len(order):
            t = tokens[order]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            many = np.diff(np.append(first, len(t)))
            # a hash of the set of prefixes: the sum of theirs; hot shingles, of which a part is here, get theirs later
            lists = K.mix(np.add.reduceat(K.mix(owner[order].view(U) + n[order].view(U)), first) + many.astype(U))
            _, kept = np.unique(lists, return_index=True)
            chosen = dealt[order][first]
            some = chosen.copy()
            chosen[kept] = True
            order, lists, some = order[np.repeat(chosen, many)], np.repeat(lists[chosen], many[chosen]), np.repeat(some[chosen], many[chosen])
            signed = (tokens[order] ^ U(1 << 63)).view(np.int64)  # in the same order
            values = [pa.array(lists.view(np.int64), mask=some), *map(pa.array, (signed, part_of(owner[order], parts[order]), parts[order], owner[order], n[order], place[order].astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(values, ["list", "token", "part", "parts", "prefix", "n", "place"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merge(key, batches)

    rows = written(packed.groupBy("bucket").applyInArrow(run, "list long, token long, part long, parts long, prefix long, n long, place long"), "bucket-postings")
    best = rows.where("list IS NOT NULL").groupBy("list").agg(F.min("token").alias("token")).select("token")
    whole = rows.where("list IS NULL").groupBy("token").agg(F.bit_xor(F.xxhash64("prefix", "n")).alias("a"), F.bit_xor(F.xxhash64("n", "prefix")).alias("b"), F.count("*").alias("c"))
    best = best.unionByName(whole.groupBy("a", "b", "c").agg(F.min("token").alias("token")).select("token"))
    return rows.join(best, "token", "left_semi").select("token", "part", "parts", "prefix", "n", "place")


def to_each_part(df: DataFrame) -> DataFrame:
    """df (token, parts, ..) with a row for each part of its shingle: what meets a side that is split by part."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def candidate_sets(docs: DataFrame, wanted: DataFrame, levels, width: int) -> DataFrame:
    """(node, s) with at least the whole set of each wanted rep, a document. The texts are read where they lie: a filter, whose size follows
    the number of wanted ones up to FILTER_MOST bits, tells which documents to work out. Those that it lets through wrongly, and repeated rows,
    cost time only: at worst, with many more wanted than it has bits, the sets of all documents are worked out and dealt out once."""

    slots = 1 << min(max(FILTER_SHARE * wanted.count(), FILTER_LEAST), FILTER_MOST).bit_length() - 1

    def cells_of(ids: np.ndarray) -> np.ndarray:
        return (K.mix(ids.astype(np.int64).view(U)) >> U(20)).astype(np.int64) & (slots - 1)

    def mark(batches, out):
        for b in batches:
            out[cells_of(b.column(0).to_numpy())] = 1

    ids = docs.sparkSession.sparkContext.broadcast(np.packbits(summed(wanted.select("rep"), mark, slots, np.uint8, lambda x: (x > 0).astype(np.uint8))))

    def run(batches):
        book, of_id = levels.value, np.unpackbits(ids.value)
        for piece in K.chunks(batches, "text", PIECE):
            piece = piece.filter(pc.is_valid(piece["doc_id"]))
            key = piece["doc_id"].to_numpy()
            piece = piece.filter(pa.array(of_id[cells_of(key)] > 0))
            sets = [x for x in (ordered(x, book) for x in shingle_sets(piece["text"], width)) if len(x)]
            if sets:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([K.digest(x) for x in sets], pa.binary()), lists], ["node", "s"])

    return docs.mapInArrow(run, "node binary, s array<long>")


def sketch_slots(docs: DataFrame) -> int:
    """The slots of the sketch for an input: a power of two that follows its splits."""
    return 1 << (min(max(SLOTS_SPLIT * docs.rdd.getNumPartitions(), SLOTS_LEAST), SLOTS_MOST)).bit_length() - 1


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, slots: int | None = None, key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, the least doc_id that links reach. Two documents link if
    100 * intersection >= percent * union of their sets. key: the column of docs that is doc_id here; hot: see HOT."""
    spark = docs.sparkSession
    arrow(spark)
    docs = texts(docs, key)
    buckets, few = partitions(docs), few_tasks(docs)
    levels = spark.sparkContext.broadcast(sketch(docs, width, slots or sketch_slots(docs)))
    made = written(signatures(docs, levels, width, percent, buckets, hot), "signatures")
    rows = made.where("n IS NOT NULL").select("doc_id", "n", "prefix", "node")
    release(spark)
    posted = written(shared_postings(made.where("bucket IS NOT NULL").select("bucket", "tokens", "owner", "place", "owners", "sizes"), percent, hot), "postings")
    group = ["prefix", "n"]
    sets = rows.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("prefix").alias("prefix"))
    # groups with a partner: by a shingle of their prefix, or inside, where sets differ after equal prefixes
    paired = posted.select(*group).unionByName(sets.groupBy(*group).count().where("count > 1").select(*group)).distinct()
    members = sets.join(paired, group, "left_semi")
    # any of the copies tells the outline of their set
    outlines = made.where("node IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "node", "bits", F.struct(*(F.get("fold", F.lit(i)).alias(f"f{i}") for i in range(FOLD))).alias("fold"))
    members = written(members.join(outlines, ["node", "rep"]).dropDuplicates(["node"]), "members")
    release(spark)

    def verified(pairs):
        """Of (u, v) those that link, by the whole sets."""
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        # dealt out by node once, for both joins, which read the one exchange: kept in memory, the sets would fill the executors
        wanted = written(members.join(ends, "node", "left_semi").select("rep").coalesce(few), "wanted")
        whole = candidate_sets(docs, wanted, levels, width).repartition(buckets, "node")
        a, b = whole.select(F.col("node").alias("u"), F.col("s").alias("su")), whole.select(F.col("node").alias("v"), F.col("s").alias("sv"))
        both = F.size(F.array_intersect("su", "sv"))
        found = pairs.join(a, "u").join(b, "v").select("u", "v", both.alias("i"), (F.size("su") + F.size("sv")).alias("t")).where(F.expr(f"100L * i >= {percent}L * (t - i)")).select("u", "v")
        found = written(found.coalesce(few), "found")
        release(spark)
        return found

    def merged(labels, found):
        # what links joins components, so it is their links that are followed
        ends = components(named(found, labels).select(F.col("c1").alias("u"), F.col("c2").alias("v")), few).toDF("component", "root")
        return written(labels.join(ends, "component", "left").select("node", F.coalesce("root", "component").alias("component")).coalesce(few), "labels")

    def named(pairs, labels):
        return pairs.join(labels.toDF("u", "c1"), "u").join(labels.toDF("v", "c2"), "v").where("c1 <> c2")

    # a component is named by the least (rep, node) in it, so its name tells its least document and no one has to gather its members
    alone = F.struct("rep", "node")
    labels = members.select("node", alone.alias("component"))
    turn = 0
    while turn <= STARS:
        # a group may hold members of several components: each such part is a unit, named by its least member
        units = written((members.join(labels, "node") if turn else members.withColumn("component", alone)).groupBy(*group, "component").agg(F.min("node").alias("first"), F.min_by("fold", "node").alias("fold"), F.count("*").alias("size")).coalesce(few), "units")
        # a shingle's bucket holds each unit with its first member's outline; in the last round, where all members are asked for, if it is the only one
        outline = F.col("fold") if turn < STARS else F.when(F.col("size") == 1, F.col("fold"))
        base = posted.join(units.select(*group, "component", "first", outline.alias("fold")), group)
        if turn:  # shingles of one component are done with
            open_tokens = base.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("parts").alias("parts"), F.count("*").alias("many")).where("a <> b").select("token", "parts", "many")
            base = written(base.join(to_each_part(open_tokens), ["token", "part"]), "base")
            posted = base.select("token", "part", "parts", *group, "place").distinct()
        one_of = {x: F.col(x) for x in ("token", "part", "parts")} | {y: F.col(x).alias(y) for x, y in {"component": "c1", "prefix": "p1", "first": "u", "n": "n1", "place": "i1", "fold": "b1"}.items()}
        one = base.select(*one_of.values())
        other = {"c1": "c2", "p1": "p2", "u": "v", "n1": "n2", "i1": "i2", "b1": "b2"}
        inner = units.groupBy(*group).agg(F.min("first").alias("u"), F.count("*").alias("many")).where("many > 1")
        if turn < STARS:
            unit = F.struct(*(F.col(x).alias(y) for x, y in other.items()))
            hub_by = ["u", "token"] if turn else ["u"]  # the same hubs at first, for few pairs; then others for each shingle, so that all meet some
            many = HUBS if turn else FIRST_HUBS
            if turn:  # shingles of few units have few pairs, which the last round takes
                one = base.where(F.col("many") > HUBS).select(*map(one_of.get, one.columns))
            hubs = one.groupBy("token").agg(F.max("parts").alias("parts"), F.array(*(F.min_by(unit, F.xxhash64(*hub_by, F.lit(turn * HUBS + k))) for k in range(many))).alias("hubs"))
            two = to_each_part(hubs.select("token", "parts", F.explode(F.array_distinct("hubs")).alias("hub"))).select("token", "part", "hub.*")
            near = one.join(two, ["token", "part"]).where("c1 <> c2")
        else:
            two = to_each_part(one.select("token", "parts", *(F.col(x).alias(y) for x, y in other.items())))
            near = one.join(two, ["token", "part"]).where("c1 < c2")
        near = near.where(may_link(F.col("n1"), F.col("i1"), F.col("n2"), F.col("i2"), percent))
        near = near.where(F.coalesce(folds_allow("b1", "b2", F.col("n1"), F.col("n2"), percent), F.lit(True)))
        if turn < STARS:
            pairs = near.select("u", "v").unionByName(units.join(inner, group).where("first <> u").select("u", F.col("first").alias("v")))
        else:
            every = members.join(labels, "node").select(*group, "component", "node")
            left, right = every.toDF("p1", "n1", "c1", "u"), every.toDF("p2", "n2", "c2", "v")
            across = near.select("p1", "n1", "c1", "p2", "n2", "c2").distinct().join(left, ["p1", "n1", "c1"]).join(right, ["p2", "n2", "c2"]).select("u", "v")
            within = left.join(right, (F.col("p1") == F.col("p2")) & (F.col("n1") == F.col("n2")) & (F.col("c1") < F.col("c2"))).select("u", "v")
            pairs = across.unionByName(within)
        likely = written(likely_pairs(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), members, percent).coalesce(few), "likely")
        release(spark)
        if turn == STARS:  # of two components first the likeliest pair, which mostly merges them; then every pair of those that are still apart
            pair = F.struct("u", "v")
            best = named(likely, labels).groupBy(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).agg(F.max_by(pair, F.struct("margin", "u", "v")).alias("best"))
            labels = merged(labels, verified(written(best.select("best.*").coalesce(few), "best")))
            likely = written(named(likely, labels).select("u", "v").coalesce(few), "rest")
        found = verified(likely.select("u", "v"))
        turn = turn + 1 if turn == STARS or found.take(1) else STARS  # a round that finds nothing is the last of the stars
        labels = merged(labels, found)
    least = sets.join(labels, "node", "left").select("node", F.coalesce("component.rep", "rep").alias("component_id"))
    out = rows.join(least, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
