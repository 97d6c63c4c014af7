"""DuckDB SQL of the queries here that SQL can express."""

from marlstone.llm.urlfilter import SECOND_LEVEL

OP3 = """
WITH r AS (SELECT page_id, url, CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0) AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
rules(what, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ruled AS (
  SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(what, length(rh || rp)) AS rv
  FROM (SELECT DISTINCT * FROM p) p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL),
known AS (SELECT doc_id AS item, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
hosts AS (
  SELECT host, count(k.bad) AS n, coalesce(sum(k.bad), 0) AS bad,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SECOND_LEVEL) THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE split_part(host, '.', -1) END AS suffix,
         array_to_string(string_split(host, '.')[CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SECOND_LEVEL) THEN -3 ELSE -2 END:], '.') AS domain
  FROM p LEFT JOIN known k ON k.item = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})', 1), '') AS BIGINT) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
levels AS (SELECT 'h' AS l, n, bad FROM hosts UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes),
moments AS (SELECT l, count(*) AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS sq, sum(bad)::DOUBLE AS b, sum(bad::DOUBLE * bad / n) AS ra FROM levels WHERE n > 0 GROUP BY l),
between_ AS (SELECT l, k, b / n * (1 - b / n) AS w, CASE WHEN k >= 2 THEN (ra - n * (b / n) * (b / n) - (k - 1) * (b / n * (1 - b / n))) / (n - sq / n) END AS v FROM moments),
strength AS (SELECT l, CASE WHEN k < 2 OR v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(0.5, w / v - 1)) END::DOUBLE AS m FROM between_),
ks AS (SELECT coalesce((SELECT m FROM strength WHERE l = 's'), 1000.0) AS ks, coalesce((SELECT m FROM strength WHERE l = 'd'), 1000.0) AS kd, coalesce((SELECT m FROM strength WHERE l = 'h'), 1000.0) AS kh,
       (coalesce(sum(bad), 0) + 0.5)::DOUBLE / (coalesce(sum(n), 0) + 10) AS p0 FROM suffixes),
ps AS (SELECT suffix, (bad + ks * p0) / (n + ks) AS p FROM suffixes, ks),
pd AS (SELECT domain, (d.bad + kd * ps.p) / (d.n + kd) AS p FROM domains d JOIN ps USING (suffix), ks),
ab AS (SELECT host, bad + kh * pd.p AS a, n - bad + kh * (1 - pd.p) AS b FROM hosts JOIN pd USING (domain), ks),
bound AS (SELECT host, a / (a + b) - 1.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM ab)
SELECT p.page_id, p.host, p.path, rule, coalesce(rv, CASE WHEN low > 0.3 THEN 'block' ELSE 'allow' END) AS verdict, round(low, 6) AS bad_bound
FROM p JOIN ruled r ON p.page_id IS NOT DISTINCT FROM r.page_id AND p.host = r.host AND p.path = r.path LEFT JOIN bound ON p.host = bound.host
""".replace("(SECOND_LEVEL)", repr(SECOND_LEVEL))

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.x AS qx, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
t AS (SELECT doc_id, len(ss) AS n, hash(unnest(ss)) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r(x, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.c FROM r JOIN e ON r.x = e.x)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, c.c AS component_id FROM s JOIN (SELECT x, min(c) AS c FROM r GROUP BY 1) c ON s.doc_id = c.x
"""

OP4 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT *, list_filter(string_split_regex(lower(raw), '[\t-\r ]+'), lambda x: x <> '') AS ws, {'doc_id': doc_id, 'line': line} AS here FROM l),
d AS (SELECT ws, min(here) AS first FROM w WHERE len(ws) >= 1 GROUP BY 1),
v AS (SELECT first, len(ws) AS n, k, list_concat(ws[:k - 1], ws[k + 1:]) AS less FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM d WHERE len(ws) >= 5)),
g AS (SELECT n, k, less, min(first) AS earliest FROM v GROUP BY ALL HAVING count(*) > 1),
o AS (SELECT v.first AS more, d.first AS fewer FROM v JOIN d ON v.less = d.ws AND len(d.ws) >= 5),
near AS (SELECT v.first FROM v JOIN g USING (n, k, less) WHERE earliest < v.first UNION SELECT more FROM o WHERE fewer < more UNION SELECT fewer FROM o WHERE more < fewer),
j AS (SELECT w.doc_id, w.raw, w.line, d.first IS NOT NULL AND d.first <> w.here AS exact, d.first IS NOT NULL AND d.first = w.here AND near.first IS NOT NULL AS close FROM w LEFT JOIN d ON w.ws = d.ws LEFT JOIN near ON d.first = near.first),
a AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line) FILTER (NOT exact AND NOT close) AS text, count(*) FILTER (exact) AS n_exact, count(*) FILTER (close) AS n_near FROM j GROUP BY 1)
SELECT x.doc_id, CASE WHEN a.doc_id IS NULL THEN x.text WHEN x.text IS NOT NULL THEN coalesce(a.text, '') END AS text, coalesce(len(string_split(x.text, chr(10))), 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near FROM documents x LEFT JOIN a ON x.doc_id = a.doc_id
"""


WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP12 = """
WITH bits AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT row_number() OVER () AS rid, doc_id, WORDS AS ws FROM documents),
dw AS (SELECT rid, w, count(*) AS c FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS c FROM (SELECT unnest(WORDS) AS w FROM benchmark) GROUP BY ALL),
hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), bits),
s AS (SELECT bucket, sum(c)::DOUBLE AS n FROM dw JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(c)::DOUBLE AS n FROM bw JOIN hashed USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT rid, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS total FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (rid)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= 20 AND doc_id IS NOT NULL AS may FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY may) AS among FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * among // 100 THEN place END AS rank FROM r
""".replace("WORDS", WORDS)

OP13 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT rid, o, part * 1000 AS base, substr(h, 2000 * part + 1, 2198) AS h FROM (SELECT *, unnest(range(greatest(0, len(h) // 2 - 99 + 999) // 1000)) AS part FROM d)),
w AS (SELECT rid, {'o': o, 's': base + i} AS here, md5(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT *, unnest(range(len(h) // 2 - 99)) AS i FROM cut)),
f AS (SELECT m, min(here) AS first FROM w GROUP BY m HAVING count(*) > 1),
r AS (SELECT rid, here.s AS s FROM w JOIN f USING (m) WHERE here > first),
n AS (SELECT rid, s, coalesce(s - lag(s) OVER (PARTITION BY rid ORDER BY s) > 100, true) AS new FROM r),
p AS (SELECT rid, s, sum(new::INT) OVER (PARTITION BY rid ORDER BY s) AS k FROM n),
z AS (SELECT rid, k, min(s) AS a, max(s) + 100 AS b FROM p GROUP BY ALL),
l AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM z),
kept AS (SELECT rid, count(*) AS spans, sum(b - a) AS removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h FROM l JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""


def op11(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The vector codes in SQL: every round a full scan of the codebooks."""
    nearest = """a{r} AS (SELECT rid, part, min({{'d': d, 'e': entry}}) AS near FROM (
      SELECT rid, p.part, entry, CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{r} c ON p.part = c.part) GROUP BY rid, part)"""
    moved = """m{r} AS (SELECT part, entry, list(m ORDER BY pos) AS x FROM (
      SELECT p.part, near.e AS entry, pos, (sum(p.x[pos]) - ((sum(p.x[pos]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM p JOIN a{r} USING (rid, part), unnest(range(1, len(p.x) + 1)) u(pos) GROUP BY ALL) GROUP BY ALL),
c{n} AS (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))"""
    steps = ",\n".join([s for r in range(rounds) for s in (nearest.format(r=r), moved.format(r=r, n=r + 1))] + [nearest.format(r=rounds)])
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({1024} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS rid, * FROM v WHERE len(x) = (SELECT len(x) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
p AS (SELECT rid, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM k, range({parts}) t(part)),
c0 AS (SELECT part, rid - 1 AS entry, CAST(x AS HUGEINT[]) AS x FROM p WHERE rid <= {entries}),
{steps},
e AS (SELECT rid, string_agg(lpad(lower(hex(near.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (rid), b
"""


def op8() -> str:
    """The licence scan in SQL, from the operator's own templates and limits."""
    from marlstone.llm import licenses as L

    text = lambda x: "'" + x.replace("'", "''") + "'"
    vocabulary, postings = L.index()
    words = ", ".join(f"({text(w)})" for w in vocabulary)
    posts = ", ".join(f"({text(w)}, {t}, {q}, {str(key).upper()}, {text(label)})" for w, t, q, key, label in postings)
    starts = ", ".join(
        f"list_filter(range(len(ws)), lambda i: {' AND '.join(f'ws[i + {k}] = {text(w)}' for k, w in enumerate(phrase.split(), 1))}) AS s{n}" for n, (phrase, _) in enumerate(L.BASE)
    )
    every = "list_concat(" + ", ".join(f"s{n}" for n in range(len(L.BASE))) + ")"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(s{n}) > 0 THEN {text(label)} END" for n, (_, label) in enumerate(L.BASE)) + "], lambda x: x IS NOT NULL)"
    return rf"""
WITH vocab(w) AS (VALUES {words}), post(w, t, q, key, label) AS (VALUES {posts}),
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
tok AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
hits AS (SELECT rid, w, i FROM tok JOIN vocab USING (w)),
df AS (SELECT w, count(DISTINCT rid) AS c FROM hits GROUP BY 1),
idf AS (SELECT w, round(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(c, 0) + 1)) + 1, 9) AS idf FROM vocab LEFT JOIN df USING (w)),
top AS (SELECT rid, t, w FROM (SELECT rid, t, w, row_number() OVER (PARTITION BY rid, t ORDER BY idf DESC, w) AS r FROM (SELECT DISTINCT rid, t, w FROM hits JOIN post USING (w)) JOIN idf USING (w)) WHERE r <= {L.RARE}),
votes AS (SELECT h.rid, post.t, i - q AS place, key, CASE WHEN top.w IS NOT NULL THEN idf ELSE 0 END AS vote FROM hits h JOIN post USING (w) JOIN idf USING (w) LEFT JOIN top ON top.rid = h.rid AND top.t = post.t AND top.w = h.w),
gathered AS (SELECT rid, t, place, sum(vote) AS got, count(*) FILTER (key) AS keys FROM votes GROUP BY ALL),
needed AS (SELECT t, any_value(label) AS label, count(*) FILTER (key) AS keys FROM post GROUP BY 1),
could AS (SELECT rid, t, sum(idf) AS could FROM top JOIN post USING (t, w) JOIN idf USING (w) GROUP BY ALL),
found AS (SELECT rid, label, least(1.0, max(got) / could) AS score FROM gathered JOIN needed USING (t, keys) JOIN could USING (rid, t) WHERE got > 0 GROUP BY rid, t, label, could HAVING least(1.0, max(got) / could) >= {L.THRESHOLD}),
f AS (SELECT rid, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY 1),
b AS (SELECT rid, doc_id, len(ws) AS n_words, {starts} FROM d),
e AS (SELECT rid, doc_id, n_words, {every} AS every, {base} AS base FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
       round(coalesce(score, CASE WHEN len(every) > 0 THEN {L.THRESHOLD} ELSE 0 END)::DOUBLE, 6) AS score
FROM e LEFT JOIN f USING (rid)
"""
