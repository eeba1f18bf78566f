"""Licence scans by diagonal voting, as DataFrame code.

1. every whole text becomes its word 2-grams with positions (with few templates those of the templates' words alone);
   Spark joins them by 64-bit hash, and then by the words themselves, to the positions of the templates' 2-grams;
2. a hit at document position p and template position q votes for the diagonal p - q. Votes are summed by (document,
   template, diagonal), on the map side first;
3. diagonals of a template that lie next to each other, no more than ``gap`` words apart, are merged: a word put in or left
   out moves the rest of a passage to a neighbouring diagonal;
4. a merged span is verified by how many distinct template positions it covers. A diagonal with a vote for
   every position is an exact place of the whole template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.urlfilter import blocked_bloom, passing

#: Fixed values of the base scan: phrases, and the label of each.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Openings of well-known public licence notices, which may be found in part.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("gnu lesser general public license version", "lgpl"),
    ("gnu affero general public license version", "agpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("all rights reserved", "all-rights-reserved"),
]

#: A template set of up to so many 2-grams is broadcast; a larger one is joined by shuffle.
BROADCAST_GRAMS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words: runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null counts as empty.

    ``translate`` makes an object of every character; of a text in ASCII alone ``lower`` changes A-Z alone and makes none.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]]) -> DataFrame:
    """``template, kind, label, gram, q, n_grams``: a row for each 2-gram position of (kind, text, label).

    A template has 2 to 64 words, so that its positions fit the bits of a long; cut longer texts.
    """
    rows = []
    for i, (kind, text, label) in enumerate(templates):
        words = text.split()
        if not 2 <= len(words) <= 64:
            raise ValueError("a template has 2 to 64 words")
        rows += [(i, kind, label, f"{a} {b}", q, len(words) - 1) for q, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return spark.createDataFrame(rows, "template int, kind string, label string, gram string, q int, n_grams int")


#: Words of so many 2-grams at most are looked up in the texts before the join; of more, every 2-gram of a text goes to it.
LISTED_GRAMS = 10_000
#: The entry that stands at the end of every text: it joins to a template of its own and brings the text's number of words.
_END = ""


def _entries(docs: DataFrame, templates: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, p, g``: of each text its 2-grams, and its end at p = its number of words, so that the words are cut once.

    With few templates only 2-grams of a first and a second word that some template has are made; no other can hit.
    """
    words = docs.select(*keys, words_of(F.col(text_col)).alias("w"))
    listed = [r[0].split(" ") for r in templates.select("gram").distinct().limit(LISTED_GRAMS + 1).collect()]
    first, second = (sorted({x[i] for x in listed}) for i in (0, 1))

    def gram(x: Column, i: Column) -> Column:
        made = F.struct(i.alias("p"), F.concat(F.col("w")[i], F.lit(" "), x).alias("g"))
        return made if len(listed) > LISTED_GRAMS else F.when(x.isin(second) & F.col("w")[i].isin(first), made)

    grams = F.filter(F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), gram), lambda x: x.isNotNull())
    return words.select(*keys, F.inline(F.array_append(grams, F.struct(F.size("w").alias("p"), F.lit(_END).alias("g")))))


def _hits(docs: DataFrame, templates: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, template, kind, label, n_grams, q, p`` of every hit, and of the end of every text, at p = its number of words.

    Few templates are broadcast. Many meet by a shuffle only the 2-grams that a Bloom filter of bounded size lets pass, hot ones
    split by the adaptive join; ends of texts never go along under one key, they keep to hashes of their rows.
    """
    entries = _entries(docs, templates, keys, text_col)
    end = docs.sparkSession.createDataFrame([(-1, "end", "", _END, 0, 0)], templates.schema)
    keyed = templates.unionByName(end).withColumn("h", F.xxhash64("gram"))
    count = templates.count()
    # The 2-gram itself goes along with its hash: a hit is a hit of the same words.
    if count <= BROADCAST_GRAMS:
        return entries.join(F.broadcast(keyed), (F.xxhash64("g") == F.col("h")) & (F.col("g") == F.col("gram")))
    bloom, blocks = blocked_bloom(keyed.select(F.col("gram").alias("key")).distinct(), count + 1)
    likely = passing(entries.withColumn("key", F.col("g")), bloom, blocks).drop("key")
    spread = F.when(F.col("g") == _END, F.xxhash64(*keys)).otherwise(F.xxhash64("g"))
    met = likely.withColumn("_h", spread).join(keyed.where("kind <> 'end'"), (F.col("_h") == F.col("h")) & (F.col("g") == F.col("gram")), "left").where((F.col("gram").isNotNull()) | (F.col("g") == _END)).drop("_h")
    return met.fillna({"template": -1, "kind": "end", "label": "", "n_grams": 0, "q": 0})


def license_spans(docs: DataFrame, templates: DataFrame, keys: list[str] | None = None, text_col: str = "text", gap: int = 2) -> DataFrame:
    """Merged spans of votes: the keys, ``template, kind, label, n_grams, start, length, seen, exact, rows``, in words.

    ``seen`` is the number of the template's 2-gram positions that the span covers; ``exact`` lists the starts of the
    exact places of the whole template in it. Rows with the same keys must have the same text. One row of kind 'end' for each key has
    the number of words as its start, and the number of rows with that key as ``rows``. Texts are read and cut into words once.
    """
    keys = keys or ["row_key"]
    diagonals = _hits(docs, templates, keys, text_col).groupBy(*keys, "template", "kind", "label", "n_grams", (F.col("p") - F.col("q")).alias("diagonal")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, q)")).alias("bits"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    apart = diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1)))
    whole = F.when(F.bit_count("bits") == F.col("n_grams"), F.col("diagonal"))
    return apart.withColumn("island", F.sum("new").over(order)).groupBy(*keys, "template", "kind", "label", "n_grams", "island").agg(
        F.min("lo").alias("start"), (F.max("hi") + 2 - F.min("lo")).alias("length"), F.bit_count(F.bit_or("bits")).alias("seen"),
        F.array_sort(F.collect_list(whole)).alias("exact"), F.max("n").alias("rows")).drop("island")


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None,
                  id_col: str = "doc_id", text_col: str = "text", gap: int = 2, coverage: float = 0.75) -> DataFrame:
    """The licences that each whole text names.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: places of the phrases, their first and
    last start (words from 0), labels of exact phrases, labels also of all spans that cover ``coverage`` of a notice, and the
    best coverage of any template.

    * null or empty text: no words, counts 0, positions null, labels empty, score 0;
    * repeated rows and null ids: a row each, scanned under a hash of id and text, so equal rows have equal results;
    * overlapping places all count; empty table: no rows; other columns are not read.
    """
    templates = template_table(docs.sparkSession, [("base", *p) for p in phrases or PHRASES] + [("notice", *n) for n in notices or NOTICES])
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("row_key"), F.col(text_col).cast("string").alias("text"))
    spans = license_spans(rows, templates, ["doc_id", "row_key"], gap=gap)
    end, base = F.col("kind") == "end", F.col("kind") == "base"
    share = F.when(~end, F.col("seen") / F.col("n_grams"))
    hit = F.size("exact") > 0
    found = spans.groupBy("doc_id", "row_key").agg(
        F.max(F.when(end, F.col("start"))).cast("long").alias("n_words"), F.max(F.when(end, F.col("rows"))).cast("int").alias("rows"),
        F.flatten(F.collect_list(F.when(base, F.col("exact")))).alias("at"), F.array_sort(F.collect_set(F.when(base & hit, F.col("label")))).alias("own"),
        F.array_sort(F.collect_set(F.when((base & hit) | (~base & ~end & (hit | (share >= coverage))), F.col("label")))).alias("every"), F.coalesce(F.max(share), F.lit(0.0)).alias("score"))
    return found.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"), F.array_join("every", ",").alias("labels"), "score", F.explode(F.sequence(F.lit(1), "rows")).alias("copy")).drop("copy")
