"""Licence scan: a positional index of rare licence words, voting on where a template lies in a file.

One pass over the texts notes, for each, which indexed words it holds and, where it holds all words of some template's
key phrase or of a base phrase, where they are; no other file can match.  Document frequencies over the whole corpus give
each indexed word its IDF.  An occurrence at place i of a word at place q of a template speaks for that template at
i - q; of each template, the RARE words of highest IDF that the file holds have a vote, whatever else the file holds.  A
template is found where one place gathers THRESHOLD of the weight that these words have in it, and all words of its key
phrase stand at that place too.  Phrases of the base list are found wherever they stand consecutively.

Native: DataFrame functions only.  Only files that can match leave the first pass, and votes are summed before they are
shuffled; nothing is grouped by anything wider than one file.

Cases: a null or empty text has no words, no places and score 0; ties between templates keep every label; repeated rows
get equal results; licence words repeated thousands of times in one file only make that file's votes more.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import through_table

#: Word characters are what is left by this class (A-Z are lower-cased first).
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and labels: fixed by the query's contract.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Templates of licence notices, fixed values: label, wording, key phrase.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products derived from this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "eupl version 1 2"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    ("artistic-2.0", "this is free software licensed under the artistic license 2 0", "artistic license 2 0"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license version 1 1"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright and related"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "unauthorized copying of this file"),
)
#: Words of highest IDF that vote for each template in a file, and the share of their weight that a place must gather.
RARE, THRESHOLD = 6, 0.7


def index(templates=TEMPLATES) -> tuple[list[str], list[tuple]]:
    """The indexed words, and postings (word, template, place, key, label)."""
    postings = []
    for t, (label, wording, phrase) in enumerate(templates):
        words, key = wording.split(), phrase.split()
        at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
        postings += [(w, t, q, at <= q < at + len(key), label) for q, w in enumerate(words)]
    base = {w for phrase, _ in BASE for w in phrase.split()}
    return sorted({p[0] for p in postings} | base), postings


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _noted(docs: DataFrame, vocabulary: list[str], phrases: list[str]) -> DataFrame:
    """For each row: n_words, the indexed words it holds, and their places where it holds all words of a phrase."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, NOT_WORD), lambda w: w != "")
    places = F.filter(F.transform(F.col("_words"), lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda x: x["w"].isin(vocabulary))
    split = docs.select(F.col("doc_id").cast("long"), F.col("text"), words.alias("_words"))
    held = split.select("doc_id", "text", "_words", F.array_intersect("_words", _array(vocabulary)).alias("held"))
    # A phrase that holds all words of another opens no file that the other doesn't.
    sets = {frozenset(p.split()) for p in phrases}
    needed = sorted(sorted(s) for s in sets if not any(t < s for t in sets))
    opened = reduce(or_, (reduce(and_, (F.array_contains("held", w) for w in s)) for s in needed))
    return held.select("doc_id", F.size("_words").cast("long").alias("n_words"), "held", F.when(opened, places).alias("places"), F.when(opened, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.col("text")).cast("binary"))).alias("file"))


def _starts(phrase: str) -> Column:
    """Places where the phrase's words stand consecutively. `places` is in order, so neighbours there are neighbours."""
    words = phrase.split()

    def at(x, j):
        fits = x["w"] == words[0]
        for k, w in enumerate(words[1:], 1):
            later = F.get(F.col("places"), j + k)
            fits = fits & (later["w"] == w) & (later["i"] == x["i"] + k)
        return F.when(fits, x["i"])

    return F.filter(F.transform(F.col("places"), at), lambda i: i.isNotNull())


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    vocabulary, postings = index(templates)
    noted = through_table(_noted(docs, vocabulary, [p for p, _ in BASE] + [x[2] for x in templates]), "licence-words")
    n = noted.count()
    df = {w: c for w, c in noted.select(F.explode("held").alias("w")).groupBy("w").count().collect()}  # a row for each indexed word at most
    idf = {w: round(math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0, 9) for w in vocabulary}
    # Ranks are corpus-wide, so a template's rarest words in a file are the first in this order that the file holds.
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w)))}
    post = F.broadcast(docs.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(q).cast("long").alias("q"), F.lit(key).alias("key"), F.lit(idf[w]).alias("idf"), F.lit(rank[w]).alias("rank")) for w, t, q, key, _ in postings)))))  # as many rows as the templates have words
    keys = {t: sum(p[3] for p in postings if p[1] == t) for t in range(len(templates))}

    # For each template, the rank of the last of its words that votes in this file.
    ranks = F.create_map(*(F.lit(x) for p in rank.items() for x in p))
    mine = [_array(sorted({rank[p[0]] for p in postings if p[1] == t})) for t in range(len(templates))]
    last = F.array(*(F.coalesce(F.get(F.array_intersect(m, F.col("ranks")), RARE - 1), F.lit(len(rank))) for m in mine))
    # Votes are many for a few bytes of file, so the number of tasks isn't left to the size.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = noted.filter("file IS NOT NULL").repartition(tasks, "file").dropDuplicates(["file"]).withColumn("ranks", F.transform("held", lambda w: ranks[w])).select("file", "held", "places", last.alias("last"))
    hits = files.select("file", "last", F.explode("places").alias("x")).select("file", "last", "x.w", "x.i")
    votes = hits.join(post, "w").select("file", "t", (F.col("i") - F.col("q")).alias("at"), "q", "key", F.when(F.col("rank") <= F.get("last", F.col("t")), F.col("idf")).otherwise(0.0).alias("vote"))
    gathered = votes.groupBy("file", "t", "at").agg(F.sum("vote").alias("got"), F.sum(F.col("key").cast("int")).alias("keys"))
    best = F.element_at(F.map_from_arrays(F.array(*(F.lit(t) for t in keys)), F.array(*(F.lit(k) for k in keys.values()))), F.col("t"))
    placed = gathered.filter((F.col("got") > 0) & (F.col("keys") == best))
    # What these words could give the template at best, each template place counted.
    could = files.select("file", "last", F.explode("held").alias("w")).join(post, "w").filter(F.col("rank") <= F.get("last", F.col("t"))).groupBy("file", "t").agg(F.sum("idf").alias("could"))
    names = F.element_at(F.map_from_arrays(F.array(*(F.lit(t) for t in range(len(templates)))), F.array(*(F.lit(x[0]) for x in templates))), F.col("t"))
    found = placed.groupBy("file", "t").agg(F.max("got").alias("got")).join(could, ["file", "t"]).withColumn("score", F.least(F.lit(1.0), F.col("got") / F.col("could"))).filter(F.col("score") >= THRESHOLD)
    per_file = found.groupBy("file").agg(F.collect_set(names).alias("found"), F.max("score").alias("score"))  # no more labels than templates

    plain = noted.filter("file IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    starts = noted.filter("file IS NOT NULL").join(per_file, "file", "left").select("doc_id", "n_words", "found", "score", *(_starts(p).alias(f"s{k}") for k, (p, _) in enumerate(BASE)))
    every = F.concat(*(F.col(f"s{k}") for k in range(len(BASE))))
    base = F.filter(F.array(*(F.when(F.size(f"s{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_union(base, F.coalesce(F.col("found"), F.array().cast("array<string>"))))
    opened = starts.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), F.concat_ws(",", F.array_sort(base)).alias("base_labels"), F.concat_ws(",", labels).alias("labels"), F.round(F.coalesce("score", F.when(F.size(every) > 0, F.lit(THRESHOLD)).otherwise(0.0)), 6).alias("score"))
    return plain.unionByName(opened)
