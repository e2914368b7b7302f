"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from arcweave.llm import licenses, linededup, queries, url_filters

UPPER, LOWER = url_filters.UPPER, url_filters.LOWER


def _license_sql() -> str:
    """Base phrases by list positions; templates as regular expressions over the joined words."""
    places, flags = [], []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        tests = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_filter(range(1, n - {len(words)} + 2), lambda i: {tests})")
        flags.append(f"CASE WHEN len(p{len(flags)}) > 0 THEN '{label}' END")
    columns = ", ".join(f"{p} AS p{i}" for i, p in enumerate(places))
    joined = f"flatten([{', '.join(f'p{i}' for i in range(len(places)))}])"
    found = [f"CASE WHEN regexp_matches(j, '{licenses.template_regex(t)}') THEN '{k}' END" for k, t in licenses.TEMPLATES.items()]
    names = lambda parts: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT doc_id, w, len(w) AS n, ' ' || array_to_string(w, ' ') || ' ' AS j FROM a),
c AS (SELECT doc_id, n, j, {columns} FROM b),
d AS (SELECT *, {joined} AS p, {names(found)} AS templates FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word,
  CAST(list_max(p) - 1 AS BIGINT) AS last_word, {names(flags)} AS base_labels, {names([*flags, *found])} AS labels,
  CAST(CASE WHEN templates <> '' THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM d"""


def _domain_sql(host: str) -> tuple[str, str]:
    last = lambda k: f"array_to_string(list_slice(string_split({host}, '.'), -{k}, -1), '.')"
    listed = "', '".join(url_filters.SECOND_LABELS)
    two = f"list_extract(string_split({host}, '.'), -2) IN ('{listed}') AND regexp_full_match(list_extract(string_split({host}, '.'), -1), '[a-z][a-z]')"
    numbers = f"regexp_matches({host}, '^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\\[.*\\])\\z')"
    both = [f"CASE WHEN {numbers} THEN {host} WHEN {two} THEN {last(k + 1)} ELSE {last(k)} END" for k in (2, 1)]
    return both[0], both[1]


def _strength_sql(nodes: str) -> str:
    """Of the grid's strengths that lack at most 1.92 of the best log likelihood, the one whose ratio to two pages is least."""
    grid = ", ".join(f"{2.0 ** (j / 2)!r}" for j in range(-8, 41))
    ll = "lgamma(s * m + k) - lgamma(s * m) + lgamma(s * (1 - m) + n - k) - lgamma(s * (1 - m)) + lgamma(s) - lgamma(s + n)"
    return f"""coalesce((SELECT s FROM
      (SELECT s, ll, max(ll) OVER () AS top FROM
        (SELECT s, sum({ll}) AS ll FROM {nodes}, (SELECT unnest([{grid}]) AS s) WHERE n > 0 AND m > 0 AND m < 1 GROUP BY s))
      WHERE ll >= top - 1.92 ORDER BY abs(ln(s / 2.0)), s LIMIT 1), 2.0)"""


def _level_sql(name: str, key: str, rows: str, parent: str) -> str:
    """Nodes with the mean m and evidence t of their parent without them, then with their priors pa, pb."""
    return f"""
{name}0 AS (SELECT {key}, n, k, (pa + pk - k) / (pa + pb + pn - n) AS m, pa + pb + pn - n AS t FROM ({rows}) {parent}),
{name} AS (SELECT {key}, n, k, held * m AS pa, held * (1 - m) AS pb, n AS pn, k AS pk FROM
  (SELECT *, greatest(2.0::DOUBLE, g * t / (t + 1 + g)) AS held FROM (SELECT *, {_strength_sql(name + "0")} AS g FROM {name}0)))"""


def _chance_sql(threshold: float) -> str:
    """Density of a beta over the angle, summed around the mean; columns a and b."""
    points = url_filters.POINTS
    reach = f"{url_filters.DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"
    low, high = f"asin(sqrt(greatest(0.0, a / (a + b) - {reach})))", f"asin(sqrt(least(1.0, a / (a + b) + {reach})))"
    level = "(2 * a - 1) * ln(sqrt(a / (a + b))) + (2 * b - 1) * ln(sqrt(b / (a + b)))"
    at = f"({low} + ({high} - {low}) * (i + 0.5) / {points})"
    d = f"exp((2 * a - 1) * ln(sin({at})) + (2 * b - 1) * ln(cos({at})) - ({level}))"
    return f"""list_sum(list_transform(range({points}), lambda i: CASE WHEN sin({at}) * sin({at}) > {threshold} THEN {d} ELSE 0.0 END))
      / list_sum(list_transform(range({points}), lambda i: {d}))"""


def _url_sql(confidence: float = 0.95, threshold: float = 0.5) -> str:
    domain, suffix = _domain_sql("host")
    rules = sorted(url_filters.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((u.host = '{h}' OR ends_with(u.host, '.{h}')) AND starts_with(path, '{p}'))", h + p, kind) for kind, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{k}'" for f, _, k in fits) + " END"
    return f"""
WITH q AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM q),
u AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '([.]?:[0-9]*|[.])\\z', '') AS named,
  try_cast(regexp_extract(path, '{url_filters.SHOWN}', 1) AS BIGINT) AS doc_id FROM v),
marks AS (SELECT doc_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1))) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
h AS (SELECT named AS host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM u LEFT JOIN marks USING (doc_id) WHERE named <> '' GROUP BY 1),
hosts AS (SELECT host, n, k, {domain} AS domain, {suffix} AS suffix FROM h),
whole AS (SELECT 0.5::DOUBLE AS pa, 0.5::DOUBLE AS pb, coalesce(sum(n), 0.0) AS pn, coalesce(sum(k), 0.0) AS pk FROM hosts),{_level_sql("s1", "suffix", "SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1", "CROSS JOIN whole")},{_level_sql("d1", "domain", "SELECT domain, suffix AS above, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2", "JOIN (SELECT suffix AS above, pa, pb, pn, pk FROM s1) USING (above)")},{_level_sql("h0", "host", "SELECT host, domain AS above, n, k FROM hosts", "JOIN (SELECT domain AS above, pa, pb, pn, pk FROM d1) USING (above)")},
h1 AS (SELECT host, pa + k AS a, pb + n - k AS b FROM h0),
blocked AS (SELECT host FROM h1 WHERE {_chance_sql(threshold)} >= {confidence})
SELECT page_id, u.host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN blocked.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN blocked ON u.named = blocked.host"""


def _line_sql() -> str:
    space = "[ \\x09-\\x0D]"
    dropped = "f.key IS NOT NULL AND k.doc_id <> f.last"
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^{space}+|{space}+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS})
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE {dropped}) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT ({dropped}) OR f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id"""


def _weight_sql(level: str) -> str:
    named = queries.MIX_WEIGHTS.get(level, {})
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in named.items()) + " ELSE 1.0 END" if named else "1.0"


def _mix_sql() -> str:
    """Water levels level by level, then prefixes in the order of a seeded digest."""
    epochs, seed = queries.MIX_EPOCHS, queries.MIX_SEED
    levels = ("domain", "lang", "source")
    parts = []
    for depth, level in enumerate(levels, 1):
        keys, up = levels[:depth], levels[: depth - 1]
        key, parent = ", ".join(keys), ", ".join(up)
        over = f"PARTITION BY {parent}" if up else ""
        given = f"(SELECT floor(sum(total) * {queries.MIX_SHARE}) FROM leaves)" if not up else "g.budget"
        join = "" if not up else f" JOIN b{depth - 1} g ON " + " AND ".join(f"c.{k} IS NOT DISTINCT FROM g.{k}" for k in up)
        cols = ", ".join(f"c.{k}" for k in keys)
        parts.append(f"""
c{depth} AS (SELECT {key}, CAST(sum(total) * {epochs} AS DOUBLE) AS capacity, CAST({_weight_sql(level)} AS DOUBLE) AS weight FROM leaves GROUP BY {key}),
v{depth} AS (SELECT {cols}, c.capacity, c.weight, c.capacity / c.weight AS fill, CAST({given} AS DOUBLE) AS given FROM c{depth} c{join}),
w{depth} AS (SELECT *, (given - coalesce(sum(capacity) OVER ({over} ORDER BY fill, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER ({over}) - coalesce(sum(weight) OVER ({over} ORDER BY fill, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM v{depth}),
x{depth} AS (SELECT *, max(CASE WHEN lev < fill THEN lev END) OVER ({over}) AS stop FROM w{depth}),
b{depth} AS (SELECT {key}, CASE WHEN stop IS NULL THEN capacity ELSE least(capacity, greatest(0, weight * stop)) END AS budget FROM x{depth})""")
    same = " AND ".join(f"r.{k} IS NOT DISTINCT FROM b.{k}" for k in levels)
    return f"""
WITH m AS (SELECT doc_id, CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' WHEN right(source, 1) IN ('5', '6', '7') THEN 'reference' ELSE 'code' END AS domain,
  lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS total FROM m GROUP BY 1, 2, 3),{",".join(parts)},
r AS (SELECT m.*, e.epoch, md5('{seed}:' || e.epoch || ':' || m.doc_id) AS place FROM m CROSS JOIN (SELECT unnest(range(0, {epochs})) AS epoch) e),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM r)
SELECT r.doc_id, r.domain, r.lang, r.source, r.n_tokens, CAST(r.epoch AS INT) AS epoch, CAST(r.after - r.n_tokens AS BIGINT) AS before
FROM s r JOIN b3 b ON {same} WHERE r.after <= floor(b.budget)"""


def _warc_sql() -> str:
    """Base32 by groups: five hex digits are four characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = []
    for group in range(8):
        value = f"CAST('0x' || substr(h, {5 * group + 1}, 5) AS INTEGER)"
        chars += [f"substr('{letters}', (({value}) >> {shift} & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {" || ".join(chars)} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def _minhash_sql() -> str:
    """All pairs of distinct sets that share a shingle, then the smallest doc_id reachable."""
    return f"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^ \\x09-\\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM a),
c AS (SELECT s, min(doc_id) AS least, len(s) AS n FROM b WHERE len(s) > 0 GROUP BY s),
e AS (SELECT least, n, unnest(s) AS x FROM c),
p AS (SELECT l.least AS u, r.least AS v FROM e l JOIN e r ON l.x = r.x AND l.least < r.least AND least(l.n, r.n) * 100 >= 80 * greatest(l.n, r.n)
  GROUP BY l.least, r.least, l.n, r.n HAVING 100 * count(*) >= 80 * (l.n + r.n - count(*))),
g AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
t AS (SELECT least AS node, least AS seen FROM c UNION SELECT t.node, g.v FROM t JOIN g ON t.seen = g.u),
k AS (SELECT node, min(seen) AS component_id FROM t GROUP BY node)
SELECT b.doc_id, CAST(len(b.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, b.doc_id) AS component_id, coalesce(k.component_id, b.doc_id) = b.doc_id AS kept
FROM b LEFT JOIN c ON b.s = c.s LEFT JOIN k ON k.node = c.least"""


def _resample_sql() -> str:
    """CRC-32 byte by byte over the hexadecimal form of each distinct feature."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    runs = lambda n: f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    every = f"flatten([w, {runs(2)}, {runs(3)}])"
    bit = "list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), CAST({} AS BIGINT))"
    byte = "CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT)"
    crc = f"xor(list_reduce(range(octet_length(encode(x))), lambda c, j: xor(c >> 8, crc_table[xor(c, {byte}) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH tab AS (SELECT list_transform(range(256), lambda b: {bit.format("b")}) AS crc_table),
d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
q AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT row, unnest({every}) AS x FROM d),
qf AS (SELECT unnest({every}) AS x FROM q),
fs AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM df UNION SELECT x FROM qf)),
bk AS (SELECT x, {crc} % 10000 AS bucket FROM fs, tab),
sc AS (SELECT bucket, count(*) AS n FROM df JOIN bk USING (x) GROUP BY 1),
tc AS (SELECT bucket, count(*) AS n FROM qf JOIN bk USING (x) GROUP BY 1),
gains AS (SELECT b.bucket, CAST(floor(1000 * ln((CAST(coalesce(tc.n, 0) AS DOUBLE) + 1) * (SELECT coalesce(sum(n), 0) + 10000.0::DOUBLE FROM sc)
  / ((CAST(coalesce(sc.n, 0) AS DOUBLE) + 1) * (SELECT coalesce(sum(n), 0) + 10000.0::DOUBLE FROM tc)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN sc USING (bucket) LEFT JOIN tc USING (bucket)),
ws AS (SELECT row, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN bk USING (x) JOIN gains USING (bucket) GROUP BY row),
sd AS (SELECT d.row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN ws USING (row)),
rk AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM sd WHERE n_words >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM rk) THEN place END AS rank FROM sd LEFT JOIN rk USING (row)"""


def _collocation_sql() -> str:
    part = lambda first, last: f"array_to_string(w[{first}:{last}], ' ')"
    grams = ", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: {part('i', f'i + {n - 1}')})" for n in (1, 2, 3, 4))
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ \\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(flatten([{grams}])) AS x FROM p) GROUP BY lang, x HAVING count(*) >= 30),
c AS (SELECT lang, x, f AS a, string_split(x, ' ') AS w FROM f WHERE contains(x, ' ')),
k AS (SELECT lang, x, a, w, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, k.x, k.k, k.a, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * k.a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.x = {part("1", "k.k")} JOIN f r ON r.lang = k.lang AND r.x = {part("k.k + 1", "len(w)")}),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
i AS (SELECT c.lang, c.a, unnest(flatten(list_transform(range(2, len(w)), lambda n: list_transform(range(1, len(w) - n + 2), lambda j: {part('j', 'j + n - 1')})))) AS x FROM c WHERE len(w) > 2),
m AS (SELECT lang, x, max(a) AS within FROM i GROUP BY lang, x),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.x) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.x = b.x
  WHERE within IS NULL OR 100::HUGEINT * within < 80::HUGEINT * a)
SELECT z.lang, rank, x AS phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000"""


ORACLES: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op2_url_filter": _url_sql(),
    "op7_warc": _warc_sql(),
    "op8_line_dedup": _line_sql(),
    "op10_mix": _mix_sql(),
    "op11_minhash": _minhash_sql(),
    "op12_resample": _resample_sql(),
    "op13_collocations": _collocation_sql(),
}
