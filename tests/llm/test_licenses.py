import re

from marlstone.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def check(docs, rows):
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, set()).add(brute(text))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in want[r.doc_id]
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    return {r.doc_id: r for r in got}


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "Released under the MIT License. mit license"), (4, "GNU general\npublic-license, cc by cc BY"),
        (5, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (6, "License mit École license"), (7, "mit license " * 3000), (7, "mit license " * 3000), (None, "Apache License"), (8, "Licensed under CC BY-NC 4.0."),
        (9, "gnu public general license"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    got = check(docs, rows)
    assert got[5].labels == "mit" and got[5].base_labels == "" and got[5].score == 1
    assert got[8].labels == "cc-by,cc-by-nc-4.0" and got[9].labels == "" and got[6].labels == ""
    assert licenses.scan(docs.limit(0)).count() == 0


def test_several_notices_in_one_file(spark):
    gpl, apache, cc = "this work is licensed under the gnu general public license version 3", "Licensed under the Apache License, Version 2.0", "licensed under cc by nc 4.0"
    mit = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    prose = "mozilla person documentation permission granted copy charge associated obtaining hereby redistribution affero lesser waived copyright "
    texts = [f"{mit}. {apache}", f"{mit} {gpl} {cc}", f"{gpl} x {apache} x {cc} x {mit}", prose * 300 + gpl + " " + prose * 300, prose * 300]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, *["plain words"] * 200])], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got[0] == ("apache,apache-2.0,mit", 1) and got[1] == ("cc-by,cc-by-nc-4.0,gpl,gpl-3.0,mit", 1)
    assert got[2] == ("apache,apache-2.0,cc-by,cc-by-nc-4.0,gpl,gpl-3.0,mit", 1)
    assert got[3] == ("gpl,gpl-3.0", 1) and got[4] == ("", 0)


def test_every_notice_is_found_alone_and_beside_all_others(spark):
    texts = [x[1] for x in licenses.TEMPLATES]
    rows = [*enumerate(texts), (1000, ". ".join(texts)), (1001, " filler words of prose ".join(reversed(texts)))]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(licenses.TEMPLATES[k][0] in got[k] for k in range(len(texts)))
    assert all({x[0] for x in licenses.TEMPLATES} <= got[k] for k in (1000, 1001))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])
