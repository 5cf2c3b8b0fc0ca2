"""SQL that gives the rows of those operator queries that SQL can express; thresholds come from the operators."""

from __future__ import annotations

from latticework.llm import jaccard, quality, spelling, substrings

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
NUMBERED = f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents)"


def op10_quality() -> str:
    """Every count by whole words and lines as strings; no hash."""
    sizes = sorted({*quality.NGRAMS, quality.BASE_WINDOW})
    parts, joins = [], []
    for n in sizes:
        parts.append(f"""g{n} AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM (SELECT r, i, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d))),
c{n} AS (SELECT w.r, count(*) AS n_words, sum(length(w.word)) AS chars FROM (SELECT DISTINCT r, i + k AS i FROM g{n}, range(0, {n}) t(k) WHERE times > 1) x JOIN w ON w.r = x.r AND w.i = x.i GROUP BY w.r)""")
        joins.append(f"LEFT JOIN c{n} USING (r)")
    grams = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_{n}gram_chars" for n in quality.NGRAMS)
    bad = " OR ".join(f"dup_{n}gram_chars > {most}::DOUBLE * word_chars" for n, most in quality.NGRAMS.items())
    return rf"""WITH {NUMBERED}, w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d), {", ".join(parts)},
t AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
l AS (SELECT r, sum(n - 1) AS n_dup, sum((n - 1) * length(line)) AS chars FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
m AS (SELECT d.doc_id, coalesce(t.n_words, 0)::BIGINT AS n_words, coalesce(t.word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines,
 coalesce(c{quality.BASE_WINDOW}.n_words, 0)::BIGINT AS n_repeat_words, coalesce(l.chars, 0)::BIGINT AS dup_line_chars, {grams} FROM d LEFT JOIN t USING (r) LEFT JOIN l USING (r) {" ".join(joins)}),
b AS (SELECT *, n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT (base_failed OR n_symbols > {quality.MAX_SYMBOLS}::DOUBLE * n_words OR dup_line_chars > {quality.MAX_LINE_SHARE}::DOUBLE * word_chars OR {bad}) AS kept FROM b"""


def op3_jaccard_join() -> str:
    """Sets of n-grams as strings, every pair that shares one counted; classes by recursion."""
    n, (over, under) = jaccard.WORDS, jaccard.SIMILARITY.as_integer_ratio()
    return f"""WITH RECURSIVE {NUMBERED}, g AS (SELECT DISTINCT r, array_to_string(list_slice(ws, i, i + {n - 1}), ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(2, len(ws) - {n - 2}))) AS i FROM d WHERE len(ws) > 0)),
s AS (SELECT r, count(*) AS n FROM g GROUP BY r), p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
k AS (SELECT a, b, common = x.n AND common = y.n AS same FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE {under} * common >= {over} * (x.n + y.n - common)),
c AS (SELECT r AS a, r AS b FROM d UNION SELECT c.a, k.b FROM c JOIN k ON k.a = c.b)
SELECT d.doc_id, (SELECT min(o.doc_id) FROM c JOIN d o ON o.r = c.b WHERE c.a = d.r) AS class_id, least(d.doc_id, (SELECT min(o.doc_id) FROM k JOIN d o ON o.r = k.b WHERE k.a = d.r AND k.same)) AS copy_id,
 (SELECT count(*) FROM k WHERE k.a = d.r) AS n_links, coalesce(s.n, 0)::BIGINT AS n_shingles FROM d LEFT JOIN s ON s.r = d.r"""


def op6_suffix_dedup() -> str:
    """Every window of every text as hexadecimal digits, with the least document it starts in."""
    n = substrings.WINDOW
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS s FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - {n - 1})) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
p AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM w JOIN f USING (s) WHERE doc_id > least),
x AS (SELECT r, i, sum(CASE WHEN step IS NULL OR step > {n} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM p),
y AS (SELECT r, span, min(i) AS a, max(i) + {n} AS b FROM x GROUP BY r, span),
z AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM y),
k AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM z JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def op11_spelling() -> str:
    """CRC-32 bit by bit; near words by equality after one code point is left out, of the longer word or of both at the same place."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents WHERE text IS NOT NULL),
s AS (SELECT run, count(*) AS n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT] END)) AS bytes FROM d GROUP BY doc_id, run),
h AS (SELECT run, n, 4294967295 - list_reduce(bytes, lambda crc, byte: list_reduce(range(0, 8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), 4294967295::BIGINT) AS h FROM s),
t AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM c a JOIN w b ON a.cut = b.word UNION SELECT DISTINCT a.word, b.word FROM c a JOIN c b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word),
k AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
m AS (SELECT a, count(*) AS n_near, max(w.n) AS most FROM k JOIN w ON w.word = k.b GROUP BY a),
f AS (SELECT m.a AS word, min(k.b) AS form, any_value(m.most) AS form_n FROM m JOIN w o ON o.word = m.a JOIN k ON k.a = m.a JOIN w ON w.word = k.b AND w.n = m.most WHERE m.most >= 2 * o.n GROUP BY m.a),
r AS (SELECT word, word AS root, 0 AS step FROM w UNION ALL SELECT r.word, f.form, r.step + 1 FROM r JOIN f ON f.word = r.root)
SELECT w.word, f.form, e.root, w.n, coalesce(m.n_near, 0)::BIGINT AS n_near, f.form_n FROM w LEFT JOIN m ON m.a = w.word LEFT JOIN f USING (word) JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) e USING (word)"""


def op13_filter_audit() -> str:
    """Every document under every order, one filter after the other."""
    return r"""WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {'A': len(ws) < 50, 'B': 100 * list_unique(ws) < 65 * len(ws),
 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, [f.A, f.B, f.C, f.D, f.E] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(a), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(b), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(c), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(d), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
k AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter, list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda c: unicode(c) - 64) AS before, unicode(substr(filter_order, step, 1)) - 64 AS own FROM o, range(1, 6) s(step)),
j AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[own] AS fail, step > 1 AND list_bool_or(list_transform(before, lambda i: fails[i])) AS gone, len(list_filter(fails, lambda v: v)) AS n_fails FROM g, k),
a AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant,
 sum(CASE WHEN fail AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM a"""


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op3_jaccard_join, op6_suffix_dedup, op10_quality, op11_spelling, op13_filter_audit)}
