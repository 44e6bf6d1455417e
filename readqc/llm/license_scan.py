"""License scan by diagonal voting, in DataFrame operations only.

Every pair of neighbouring words of a text is hashed; the hashes join to the places of the same pair in
the sentences of licenses and of notices. A hit, whose words are then compared, at word i of the text and place j of a notice votes for the
diagonal i - j. Votes are added up by diagonal, as a bit for each place of the notice, so that a place counts once however often its words
come; neighbouring diagonals of one notice merge (words may be inserted or missing): each diagonal with those that follow it one by one within one of the distances WIDTHS, so
that words of the notice which stand before or behind it can't draw a span apart. A diagonal or a merged span counts if its places
are enough of the notice and dense. The phrases of the base rule are notices too, of which every pair must vote on one diagonal.

Nulls: a null text is an empty text: no words, no labels, score 0; a null doc_id stays null. Repeated rows give a
row each. Labels that tie are all named, in order. Texts of any length are read whole. An empty table has an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base rule.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences of public licences and of notices that name them, as words in lower case, with the labels that the method adds.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution": "cc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Pairs of a notice at most: a bit each of a long.
PAIRS = 63

#: How near the next diagonal must be to merge, and the distances within which all of a span lie; the share of a notice's pairs that must vote; the share of a span's pairs that must. A span that counts is at most 1 / DENSE times
#: its votes long, so more than two thirds of PAIRS words can't have been inserted.
NEAR, WIDTHS, COVER, DENSE = 2, (2, 4, 8, 16, 32, 42), 0.8, 0.6


def _rows(notices: dict[str, str]) -> list[tuple[int, str, bool, int, int, str, str]]:
    """(notice, label, base, pairs, place, a, b): each pair of neighbouring words of each notice."""
    rows = []
    for k, (text, label, base) in enumerate([(t, x, True) for t, x in BASE.items()] + [(t, x, False) for t, x in notices.items()]):
        w = text.split()
        if not 2 <= len(w) <= PAIRS + 1:
            raise ValueError(f"a notice has 2 to {PAIRS + 1} words; cut longer texts into sentences: {text[:60]!r}")
        rows += [(k, label, base, len(w) - 1, j, a, b) for j, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    return rows


def _notices(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """The pairs as a table, with a last one that keeps texts without a hit. Its size is that of the lists, whatever the corpus."""
    rows = [*_rows(notices), (-1, "", False, 0, 0, "", "")]
    table = spark.createDataFrame(rows, "notice int, label string, base boolean, pairs int, place int, a string, b string")
    return table.withColumn("h", F.xxhash64("a", "b"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the largest share of
    a notice that a counted span covers; 0 without one). notices: sentences in lower case with their labels, for NOTICES."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # lower() also maps U+212A to an ASCII letter, unlike the rule; such texts take the slower way
    low = F.when(F.instr(whole, "K") > 0, F.translate(whole, UPPER, UPPER.lower())).otherwise(F.lower(whole))
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.split(low, BREAK).alias("w"))
    lead = (F.col("w")[0] == "").cast("int")
    trail = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    pair = lambda x, y: F.struct(F.xxhash64(x, y).alias("h"), x.alias("a"), y.alias("b"))
    pairs = F.transform("w", lambda x, i: pair(x, F.get(F.col("w"), i + 1)))
    # one entry more, which matches the mark that keeps texts without a hit
    counted = split.select("row", "doc_id", lead.alias("lead"), (F.size("w") - lead - trail).cast("long").alias("n_words"), F.array_append(pairs, pair(F.lit(""), F.lit(""))).alias("pairs_of"))
    every = counted.select("row", "doc_id", "lead", "n_words", F.posexplode("pairs_of").alias("i", "of")).select("row", "doc_id", "lead", "n_words", "i", "of.*")
    table = F.broadcast(_notices(spark, NOTICES if notices is None else notices).withColumnsRenamed({"a": "word", "b": "next"}))
    # pairs meet by their hashes, and count if the words are the same
    same = (F.col("a") == F.col("word")) & (F.col("b") == F.col("next"))
    hits = every.join(table, "h").where(same & ((F.col("notice") == -1) | (F.col("i") + 1 < F.col("lead") + F.col("n_words"))))
    hits = hits.select("row", "doc_id", "n_words", "notice", "label", "base", "pairs", F.expr("shiftleft(1L, place)").alias("bit"), (F.col("i") - F.col("lead")).alias("i"), (F.col("i") - F.col("lead") - F.col("place")).alias("diagonal"))
    by = ["row", "doc_id", "n_words", "notice", "label", "base", "pairs"]
    lines = hits.groupBy(*by, "diagonal").agg(F.bit_or("bit").alias("places"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    # what is verified is how many different places of the notice have their words there, in one diagonal or in those that merge
    every = Window.partitionBy("row", "notice").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(every)) > NEAR, F.lit(True)).cast("int")
    lines = lines.withColumn("apart", apart).withColumn("run", F.sum("apart").over(every))
    along = Window.partitionBy("row", "notice", "run").orderBy("diagonal")

    def share(places, lo, hi):
        covered = F.bit_count(places)
        return F.when((covered >= COVER * F.col("pairs")) & (covered >= DENSE * (hi - lo + 1)), covered / F.col("pairs"))

    merged = [share(*(f(c).over(along.rangeBetween(0, width)) for f, c in ((F.bit_or, "places"), (F.min, "lo"), (F.max, "hi")))) for width in WIDTHS]
    own = F.when(F.col("base"), F.when(F.bit_count("places") == F.col("pairs"), 1.0)).otherwise(F.greatest(share(F.col("places"), F.col("lo"), F.col("hi")), *merged))
    spans = lines.withColumn("share", F.when(F.col("notice") >= 0, own)).withColumn("counts", F.col("share").isNotNull())
    is_base = F.col("counts") & F.col("base")
    joined = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(is_base, 1)).alias("n_base"),
            F.min(F.when(is_base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(is_base).alias("base_labels"),
            joined(F.col("counts")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("counts"), F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def scan_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, on words instead of their hashes."""
    rows = [f"({k}, '{label}', {base}, {pairs}, {place}, '{a}', '{b}')" for k, label, base, pairs, place, a, b in _rows(NOTICES)]
    share = "CASE WHEN bit_count({p}) >= {c}::DOUBLE * pairs AND bit_count({p}) >= {d}::DOUBLE * ({h} - {l} + 1) THEN bit_count({p})::DOUBLE / pairs END"
    merged = [share.format(p=f"bit_or(places) OVER w{w}", h=f"max(hi) OVER w{w}", l=f"min(lo) OVER w{w}", c=COVER, d=DENSE) for w in WIDTHS]
    own = f"CASE WHEN base THEN CASE WHEN bit_count(places) = pairs THEN 1.0::DOUBLE END ELSE greatest({', '.join([share.format(p='places', h='hi', l='lo', c=COVER, d=DENSE), *merged])}) END"
    windows = ", ".join(f"w{w} AS (PARTITION BY r, notice, run ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {w} FOLLOWING)" for w in WIDTHS)
    return rf"""
WITH notices(notice, label, base, pairs, place, a, b) AS (VALUES {", ".join(rows)}),
texts AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {table}),
words AS (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS i FROM texts),
pairs AS (SELECT r, i, a, lead(a) OVER (PARTITION BY r ORDER BY i) AS b FROM words),
lines AS (SELECT r, notice, label, base, pairs, i - place AS diagonal, bit_or(1::BIGINT << place::INTEGER) AS places, min(i) AS lo, max(i) AS hi
  FROM pairs JOIN notices USING (a, b) GROUP BY ALL),
cut AS (SELECT *, CASE WHEN coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, notice ORDER BY diagonal) > {NEAR}, true) THEN 1 ELSE 0 END AS apart FROM lines),
runs AS (SELECT *, sum(apart) OVER (PARTITION BY r, notice ORDER BY diagonal) AS run FROM cut),
spans AS (SELECT r, label, base, diagonal AS start, {own} AS share FROM runs WINDOW {windows}),
good AS (SELECT * FROM spans WHERE share IS NOT NULL)
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
  min(start) FILTER (base)::BIGINT AS first_word, max(start) FILTER (base)::BIGINT AS last_word,
  coalesce(list_aggregate(list_sort(list(DISTINCT label) FILTER (base)), 'string_agg', ','), '') AS base_labels,
  coalesce(list_aggregate(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), 'string_agg', ','), '') AS labels,
  coalesce(max(share), 0.0)::DOUBLE AS score
FROM texts LEFT JOIN good USING (r) GROUP BY r"""
