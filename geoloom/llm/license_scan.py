"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word 2-gram of every text is joined to the places it has in the templates.  A hit
at word p of a text and word i of a template votes for the diagonal p - i.  A phrase stands where
one diagonal has all its votes; for longer templates neighbouring diagonals, which insertions and
deletions make, are merged, and a merged span is verified by its coverage of the template and its
length.  Grams are compared word by word in the join, so votes are exact, not only equal hashes.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Opening sentences of public license texts, as their stewards word them.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]

#: A word is a run of these after lower-casing A-Z; the pattern has upper case as well, so that it can run on the text itself.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Neighbouring diagonals differ by so many words at most, and their hits lie this near.
DRIFT, GAP = 3, 8
#: A merged span counts with this share of its template's grams, and at most this many times its length.
COVERAGE, STRETCH = 0.6, 1.6


def _grams(spark) -> DataFrame:
    """(a, b, tpl, i, n_grams, label, base): a constant table of a few hundred rows."""
    rows = []
    for tpl, (text, label) in enumerate(PHRASES + TEMPLATES):
        w = text.split()
        rows += [f"('{w[i]}','{w[i + 1]}',{tpl},{i},{len(w) - 1},'{label}',{str(tpl < len(PHRASES)).lower()})" for i in range(len(w) - 1)]
    return spark.sql("select * from values " + ",".join(rows) + " as t(a, b, tpl, i, n_grams, label, base)")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the verified
    spans array<struct<first, last, label, coverage, base>>.

    One shuffle, by row, of a row for each document and each gram that some template may have;
    templates are constants, so their broadcast doesn't grow.  A task holds one document's hits at
    most.  Null texts are empty, texts without words give zeros and empty label strings; repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    grams = _grams(spark)
    lefts = sorted({w for t, _ in PHRASES + TEMPLATES for w in t.split()[:-1]})
    rights = sorted({w for t, _ in PHRASES + TEMPLATES for w in t.split()[1:]})
    listed = lambda ws: ",".join(f"'{w}'" for w in ws)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"),
    )
    picked = f"filter(sequence(0, size(w) - 2), p -> w[p] in ({listed(lefts)}) and w[p + 1] in ({listed(rights)}))"
    rows = rows.select(
        "rid", "doc_id", F.size("w").cast("long").alias("n_words"),
        F.expr(f"case when size(w) < 2 then cast(array() as array<struct<p:int,a:string,b:string>>) else transform({picked}, p -> struct(p as p, w[p] as a, w[p + 1] as b)) end").alias("g"),
    )
    hits = (
        rows.select("rid", "doc_id", "n_words", F.explode_outer("g").alias("g"))
        .select("rid", "doc_id", "n_words", "g.p", "g.a", "g.b")
        .join(F.broadcast(grams), ["a", "b"], "left")
        .where("tpl is not null or p is null or p >= 0")
        .select("rid", "doc_id", "n_words", "p", "tpl", "i", "n_grams", "label", "base", (F.col("p") - F.col("i")).alias("diag"))
    )
    diagonals = (
        hits.repartition("rid")
        .groupBy("rid", "doc_id", "n_words", "tpl", "diag", "n_grams", "label", "base")
        .agg(F.count("p").alias("votes"), F.min("p").alias("first"), (F.max("p") + 1).alias("last"))
    )
    by = Window.partitionBy("rid", "tpl").orderBy("first", "diag")
    near = (F.col("first") - F.lag("last").over(by) <= GAP) & (F.abs(F.col("diag") - F.lag("diag").over(by)) <= DRIFT)
    islands = diagonals.withColumn("new", F.when(F.col("base") | ~F.coalesce(near, F.lit(False)), 1).otherwise(0)).withColumn("island", F.sum("new").over(by))
    merged = islands.groupBy("rid", "doc_id", "n_words", "tpl", "n_grams", "label", "base", "island").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("diag").alias("diag")
    )
    covered = F.least(F.lit(1.0), F.col("votes") / F.col("n_grams"))
    length = F.col("last") - F.col("first") + 1
    good = F.when(F.col("base"), F.col("votes") == F.col("n_grams")).otherwise((covered >= COVERAGE) & (length <= STRETCH * (F.col("n_grams") + 1)))
    span = F.when(good, F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "label", covered.alias("coverage"), "base"))
    out = merged.groupBy("rid", "doc_id", "n_words").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    base = "filter(spans, s -> s.base)"
    joined = lambda s: F.expr(f"array_join(array_sort(array_distinct(transform({s}, s -> s.label))), ',')")
    return out.select(
        "doc_id", "n_words",
        F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"array_min(transform({base}, s -> s.first))").alias("first_word"),
        F.expr(f"array_max(transform({base}, s -> s.first))").alias("last_word"),
        joined(base).alias("base_labels"),
        joined("spans").alias("labels"),
        F.expr("coalesce(array_max(transform(spans, s -> s.coverage)), 0D)").alias("score"),
        "spans",
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    return found.drop("spans")


def oracle_sql() -> str:
    """DuckDB SQL of what the base rule fixes, and of the merged diagonals, over documents."""
    texts = PHRASES + TEMPLATES
    grams = ",".join(f"('{w[i]}','{w[i + 1]}',{t},{i},{len(w) - 1},'{label}',{str(t < len(PHRASES)).lower()})" for t, (s, label) in enumerate(texts) for w in [s.split()] for i in range(len(w) - 1))
    return f"""
with d as (select row_number() over () rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
g(a, b, tpl, i, n_grams, label, base) as (values {grams}),
e as (select rid, unnest(generate_series(0, len(w) - 2)) p from d where len(w) > 1),
h as (select e.rid, e.p, g.tpl, g.i, g.n_grams, g.label, g.base from e join d using (rid) join g on d.w[e.p + 1] = g.a and d.w[e.p + 2] = g.b),
q as (select rid, tpl, n_grams, label, base, p - i diag, count(*) votes, min(p) f, max(p) + 1 l from h group by all),
r as (select *, case when base or not coalesce(f - lag(l) over x <= {GAP} and abs(diag - lag(diag) over x) <= {DRIFT}, false) then 1 else 0 end new
      from q window x as (partition by rid, tpl order by f, diag)),
s as (select *, sum(new) over (partition by rid, tpl order by f, diag rows unbounded preceding) island from r),
m as (select rid, tpl, n_grams, label, base, island, sum(votes) votes, min(f) f, max(l) l from s group by all),
v as (select *, least(1.0::double, votes::double / n_grams) cov from m
      where case when base then votes = n_grams else least(1.0::double, votes::double / n_grams) >= {COVERAGE} and l - f + 1 <= {STRETCH} * (n_grams + 1) end),
a as (select rid, count(*) filter (base) n_base, min(f) filter (base) first_word, max(f) filter (base) last_word,
      coalesce(string_agg(distinct label, ',' order by label) filter (base), '') base_labels, string_agg(distinct label, ',' order by label) labels, max(cov) score
      from v group by rid)
select d.doc_id, len(d.w)::bigint n_words, coalesce(a.n_base, 0)::bigint n_base, a.first_word::bigint first_word, a.last_word::bigint last_word,
       coalesce(a.base_labels, '') base_labels, coalesce(a.labels, '') labels, coalesce(a.score, 0)::double score
from d left join a using (rid)"""


