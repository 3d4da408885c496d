"""The results of this subpackage's queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .line_dedup import SITES
from .mixing import DOMAIN_WEIGHTS
from .quality_rules import BASE_RULES, MARKS, MEASURES, RULES, STOP_WORDS, WINDOW, Rule
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE


def sharding_sql(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> str:
    """Every level's winner by the least draw; CRC-32 byte by byte from its table."""
    nodes = []
    for i in range(shards + 1):
        r, k = (f"r{i // (per_rack * racks_per_region)}", f"k{i // per_rack}") if i < shards else (f"new{i}", f"new{i}")
        nodes.append(f"('{r}', '{k}', {i})")
    draw = "-ln((CAST('0x' || substr(md5(name || '|' || id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / weight"

    def descent(tag: str, most: int) -> str:
        return f"""
    region_{tag} AS (SELECT id, arg_min(region, draw) AS region FROM (SELECT id, region, {draw.replace("name", "region")} AS draw FROM ids, (SELECT region, count(*) AS weight FROM tree WHERE shard < {most} GROUP BY region)) GROUP BY id),
    rack_{tag} AS (SELECT id, region, arg_min(rack, draw) AS rack FROM (SELECT id, region, rack, {draw.replace("name", "region || '/' || rack")} AS draw FROM region_{tag} JOIN (SELECT region, rack, count(*) AS weight FROM tree WHERE shard < {most} GROUP BY region, rack) USING (region)) GROUP BY id, region),
    shard_{tag} AS (SELECT id, arg_min(shard, draw) AS shard FROM (SELECT id, shard, {draw.replace("name", "region || '/' || rack || '/' || shard").replace("/ weight", "")} AS draw FROM rack_{tag} JOIN (SELECT * FROM tree WHERE shard < {most}) USING (region, rack)) GROUP BY id)"""

    return f"""
WITH tree AS (SELECT * FROM (VALUES {", ".join(nodes)}) t(region, rack, shard)),
    crc AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n))),
    docs AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce(text, '') AS body FROM documents),
    summed AS (SELECT doc_id, id, CAST(strlen(body) + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, crc.tab[xor(c & 255, b) + 1]))) AS text_crc32 FROM docs, crc),
    ids AS (SELECT DISTINCT id FROM docs),{descent("now", shards)},{descent("then", shards + 1)}
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(a.shard AS INTEGER) AS shard,
    CAST(row_number() OVER (PARTITION BY a.shard ORDER BY md5(id), doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(b.shard AS INTEGER) AS grown_shard
FROM summed JOIN shard_now a USING (id) JOIN shard_then b USING (id)"""


EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""

LINE_DEDUP_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT r, doc_id, site, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
    t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
    bad AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {SITES}),
    k AS (SELECT t.*, bad.bare IS NOT NULL AS out FROM t LEFT JOIN bad USING (bare)),
    c AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '') AS text FROM k GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(text) AS BIGINT) AS n_kept, sha256(text) AS text_sha256 FROM c"""


def mixing_sql(share: float, epochs: int, seed: int) -> str:
    weight = "CASE domain " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(DOMAIN_WEIGHTS)) + " ELSE 0 END"

    def fill(nodes: str, parent: str, name: str, out: str) -> str:
        """nodes: parent, name, budget, cap, w."""
        return f"""(SELECT *, CASE WHEN fit IS NULL THEN cap ELSE least(cap, greatest(fit, 0) * w) END AS {out} FROM (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER (PARTITION BY {parent}) AS fit FROM (
        SELECT *, CASE WHEN rest > 0 THEN (budget - filled) / rest END AS level FROM (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY ratio, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(w) OVER (PARTITION BY {parent} ORDER BY ratio, {name} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE CAST('inf' AS DOUBLE) END AS ratio FROM {nodes})))))"""

    return rf"""
WITH rows AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
        CAST(CAST('0x' || substr(md5(coalesce(source, '')), 1, 7) AS BIGINT) % {len(DOMAIN_WEIGHTS)} AS INTEGER) AS domain FROM documents),
    caps AS (SELECT domain, lang, source, sum(tokens) AS tokens, CAST(sum(tokens) * {epochs} AS DOUBLE) AS cap FROM rows GROUP BY ALL),
    d AS (SELECT 0 AS root, domain, sum(cap) AS cap, CAST({weight} AS DOUBLE) AS w, least({share} * sum(sum(tokens)) OVER (), sum(sum(cap)) OVER ()) AS budget FROM caps GROUP BY domain),
    dg AS (SELECT domain, given FROM {fill("d", "root", "domain", "given")}),
    l AS (SELECT domain, lang, sum(cap) AS cap, 1.0::DOUBLE AS w, any_value(given) AS budget FROM caps JOIN dg USING (domain) GROUP BY domain, lang),
    lg AS (SELECT domain, lang, given FROM {fill("l", "domain", "lang", "given")}),
    s AS (SELECT caps.*, 1.0::DOUBLE AS w, lg.given AS budget FROM caps JOIN lg ON caps.domain = lg.domain AND caps.lang IS NOT DISTINCT FROM lg.lang),
    sg AS (SELECT domain, lang, source, given, CASE WHEN tokens > 0 THEN CAST(floor(given / tokens + 1e-9) AS BIGINT) ELSE 0 END AS whole, tokens AS held FROM {fill("s", "domain, lang", "source", "given")}),
    o AS (SELECT r.*, given, whole, given - whole * held AS rest, md5('{seed}|' || whole || '|' || id) AS h FROM rows r JOIN sg ON r.domain = sg.domain AND r.lang IS NOT DISTINCT FROM sg.lang AND r.source IS NOT DISTINCT FROM sg.source),
    b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN given > 0 AND whole < {epochs} AND before + tokens / 2 <= rest + 1e-6 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM b"""


def quality_rules_sql() -> str:
    """Measures by rows of words, windows and lines; the rules as comparisons of whole numbers."""
    quoted = lambda texts: ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    listed = quoted(sorted({w + mark for words in STOP_WORDS.values() for w in words for mark in ("", *MARKS)}))

    def broken(rule: Rule) -> str:
        whole = rule.whole or "1"
        bounds = [f"{rule.part} * 1000 {sign} {whole} * {bound}" for sign, bound in (("<", rule.low), (">", rule.high)) if bound is not None]
        return f"({whole} > 0 AND n_words >= {rule.words} AND ({' OR '.join(bounds)}))"

    names = ", ".join(f"CASE WHEN {broken(rule)} THEN '{rule.name}' END" for rule in (*BASE_RULES, *RULES))
    base = " OR ".join(broken(rule) for rule in BASE_RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x IN ({listed})) AS stops FROM d),
    windows AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS window_words FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) > {WINDOW})),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, window_words) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS pos FROM twice) GROUP BY r),
    m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals, CAST(len(stops) AS BIGINT) AS n_stop_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (r))
SELECT doc_id, {", ".join(MEASURES)}, concat_ws(',', {names}) AS failed, {base} AS base_failed, concat_ws(',', {names}) = '' AS kept FROM m"""


def vector_codes_sql() -> str:
    """Each round's codebooks are a table of their own; every part is compared with every entry."""

    def nearest(books: str) -> str:
        return f"""SELECT vec_id, part, v, d.e AS entry, d.d AS distance FROM (SELECT vec_id, part, p.v AS v, min({{'d': p.norm - 2 * CAST(list_inner_product(p.d, b.d) AS BIGINT) + b.norm, 'e': entry}}) AS d FROM parts p JOIN {books} b USING (part) GROUP BY ALL)"""

    rounds = []
    for i in range(1, ROUNDS + 1):
        rounds.append(f"""
    near_{i} AS MATERIALIZED ({nearest(f"books_{i - 1}")}),
    moved_{i} AS (SELECT part, entry, list(mean ORDER BY pos) AS v FROM (SELECT part, entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM near_{i}) GROUP BY ALL) GROUP BY ALL),
    books_{i} AS MATERIALIZED (SELECT part, entry, v, {_FLOATS}, {_NORM} FROM (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books_{i - 1} b LEFT JOIN moved_{i} m USING (part, entry))),""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, part, v, {_FLOATS}, {_NORM} FROM (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM kept, range({PARTS}) t(part))),
    books_0 AS MATERIALIZED (SELECT part, n AS entry, v, d, norm FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM kept) USING (vec_id) WHERE n < {ENTRIES}),{"".join(rounds)}
    found AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM ({nearest(f"books_{ROUNDS}")}) GROUP BY vec_id),
    books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books_{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM found JOIN kept USING (vec_id), books"""


_FLOATS, _NORM = "list_transform(v, lambda x: CAST(x AS DOUBLE)) AS d", "CAST(list_sum(list_transform(v, lambda x: x * x)) AS BIGINT) AS norm"


def conversation_repair_sql() -> str:
    """The cheapest edits by a fold over each conversation's rows: for each state the cost, in eight digits, and the letters so far; the least text is the least cost and then the first in ASCII order."""

    def add(x: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(substr({x}, 1, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({x}, 9) || '{letter}'"

    def bound(name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def inserted(x: str, body: str) -> str:
        """body over z, the states of x with turns put in."""
        late = f"{{'s0': {x}.s0, 's1': {x}.s1, 's2': least(y.a, {add(f'{x}.s3', '2', 'I')}), 's3': least({x}.s3, {add('y.a', '2', 'I')})}}"
        return bound("y", f"{{'a': least({x}.s2, {add(f'{x}.s0', '2', 'I')}, {add(f'{x}.s1', '2', 'I')})}}", bound("z", late, body))

    gone = ", ".join(f"'s{i}': {add(f'z.s{i}', '3', 'D')}" for i in range(4))
    keep, change = "(CASE WHEN x.k >= 4 THEN 1 ELSE 0 END)", "(CASE WHEN x.k >= 4 THEN 3 ELSE 2 END)"
    kept = lambda at, k: f"CASE WHEN x.k % 4 = {k} THEN {add(f'z.s{at}', keep, 'K')} END"
    changed = lambda at: add(f"z.s{at}", change, "R")
    step = f"""CASE WHEN x.k >= 8 THEN {{'k': 0, {gone}}} ELSE {{'k': 0, 's0': {add('z.s0', '3', 'D')}, 's1': least({add('z.s1', '3', 'D')}, {kept(0, 0)}),
        's2': least({add('z.s2', '3', 'D')}, {changed(0)}, {changed(1)}, {changed(3)}, {kept(0, 1)}, {kept(1, 1)}, {kept(3, 1)}), 's3': least({add('z.s3', '3', 'D')}, {changed(2)}, {kept(2, 2)})}} END"""
    none = "CAST(NULL AS VARCHAR)"
    bare = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
    return rf"""
WITH crc AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n))),
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
    hashed AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(id)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]))) % 20 AS f FROM given, crc),
    damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE f <> 0),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
    coded AS (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, {bare} AS bare FROM numbered),
    kinds AS (SELECT *, CASE WHEN bare = '' THEN 9 WHEN again THEN 8 ELSE CASE ini WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 4 END END AS k,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM coded),
    sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE k = 9) AS blank, count(*) FILTER (WHERE k = 8) AS duplicate, count(*) FILTER (WHERE k BETWEEN 4 AND 7) AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'k': k, 's0': {none}, 's1': {none}, 's2': {none}, 's3': {none}}} ORDER BY i) AS rows FROM kinds GROUP BY conv_id),
    folded AS (SELECT *, list_reduce(list_prepend({{'k': 0, 's0': '00000000', 's1': {none}, 's2': {none}, 's3': {none}}}, rows), lambda p, x: {inserted('p', step)}) AS e FROM sums),
    best AS (SELECT *, {inserted('e', 'least(z.s0, z.s3)')} AS b FROM folded),
    edits AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(substr(b, 1, 8) AS BIGINT) AS cost, substr(b, 9) AS audit FROM best),
    letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS pos FROM edits WHERE audit <> ''),
    placed AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS emitted FROM letters),
    turns AS (SELECT p.*, c.role, c.text, c.ini, max(CASE WHEN letter = 'K' AND c.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS has_system FROM placed p LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i),
    texts AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (emitted - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS whole FROM turns WHERE letter <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN edits e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id"""
