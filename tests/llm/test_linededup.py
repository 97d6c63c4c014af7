import random
import re

from marlstone.llm import linededup


def words(line):
    return tuple(w for w in re.split("[\t-\r ]+", line.lower()) if w)


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    """(doc_id, text) with distinct ids: the text kept, and how many lines went for being equal and for being near."""
    seen, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None or doc_id is None:
            out[doc_id] = (text, 0, 0)
            continue
        kept, exact, near = [], 0, 0
        for line in text.split("\n"):
            w = words(line)
            if len(w) < linededup.MIN_WORDS:
                kept.append(line)
                continue
            if w in seen:
                exact += 1
            elif len(w) >= linededup.NEAR_WORDS and any(len(s) >= linededup.NEAR_WORDS and abs(len(s) - len(w)) < 2 and within_one(s, w) for s in seen):
                near += 1
                seen.append(w)
            else:
                kept.append(line)
                seen.append(w)
        out[doc_id] = ("\n".join(kept), exact, near)
    return out


def check(docs, rows):
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in linededup.dedup(docs).collect()}
    assert got == brute(rows)


def test_random_lines(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 10, 11]))] for _ in range(25)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                rng.choice([lambda k=k, w=w: w.pop(k), lambda k=k, w=w: w.insert(k, rng.choice("xyz")), lambda k=k, w=w: w.__setitem__(k, rng.choice("xyz"))])()
            lines.append("  ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((d if d else None, "\n".join(lines)))
    check(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_near int"), rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(4000))
    rows = [(1, None), (2, ""), (3, "one two\n\none two"), (4, long), (5, long + " more"), (6, "same five words right here\nSame  five words right here"), (None, "same five words right here")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, line string")
    check(docs, rows)
    twice = linededup.dedup(docs.union(docs)).collect()
    assert len(twice) == 14 and {r.text for r in twice if r.doc_id == 4} == {long}
    assert linededup.dedup(docs.limit(0)).count() == 0


def test_clashing_columns_come_back_unchanged(spark):
    names = ["gone", "_text", "_k", "_b", "_id", "of", "parts", "mine", "row", "bucket", "line", "raw", "words", "first", "near", "h1"]
    rows = [(d, "a line that stands twice here\nanother line of text " + str(d) * d, *(f"{n}{d}" for n in names)) for d in range(1, 5)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = {r.doc_id: r for r in linededup.dedup(docs).collect()}
    assert all(got[d][n] == f"{n}{d}" for d in range(1, 5) for n in names)
    assert {d: got[d].text for d in got} == {d: t for d, (t, _, _) in brute([r[:2] for r in rows]).items()}


def test_limits_are_parameters(spark):
    docs = spark.createDataFrame([(1, "ok\none two three four five six"), (2, "ok\none two three four five 6")], "doc_id long, text string")
    got = lambda **k: {r.doc_id: r.text for r in linededup.dedup(docs, **k).collect()}
    assert got()[2] == "" and got(min_words=2)[2] == "ok" and got(near_words=7)[2] == "one two three four five 6"


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])
