"""Each operator against a brute-force version, and its cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import common, components, decontamination, exact_dedup, html_extraction, line_dedup, lm_scoring, mixing, pii, sharding, simhash, toxicity
from tracewright.llm.words import WordHasher, chained

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
WORDS = ["the", "of", "Stone", "river", "moves", "über", "a", "grain", "hill", "then", "under", "light"]


def make(rng: random.Random, n: int) -> list[tuple]:
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.35:
            words = (rng.choice(rows)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        else:
            text = rng.choice([" ", "\n", "  "]).join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 3, 10, 60, 60, 60])))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(text or "")))
    return [*rows, (None, "no id here", "en", "s1", 10), (n, None, None, None, None), (n + 1, "", "en", "s2", 0), (3, rows[3][1], rows[3][2], rows[3][3], rows[3][4])]


@pytest.fixture(scope="module")
def rows():
    return make(random.Random(5), 160)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none, rows):
    out = sharding.place(docs, sharding.regular_topology(16)).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"}
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sharding.place(none, sharding.regular_topology(16)).count() == 0
    clashing = docs.selectExpr("*", "1 AS shard", "2 AS _region", "3 AS key", "4 AS row", "5 AS slot")
    named = sharding.shard_of(clashing, "doc_id", sharding.regular_topology(16))
    assert named.columns == [*docs.columns, "_region", "key", "row", "slot", "shard"] and {(r._region, r.key, r.row, r.slot) for r in named.collect()} == {(2, 3, 4, 5)}
    assert sorted((str(r.doc_id), r.shard) for r in named.collect()) == sorted((str(r.doc_id), r.shard) for r in out)
    assert sharding.place(clashing, sharding.regular_topology(16)).count() == len(rows)


def test_sharding_moves_only_between_changed_subtrees(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = sharding.regular_topology(16)
    after = [s._replace(weight=3.0) if s.shard == 15 else s for s in before]
    both = sharding.shard_of(sharding.shard_of(ids, "doc_id", before, "a"), "doc_id", after, "b").collect()
    counts = Counter(r.a for r in both)
    assert all(150 < counts[i] < 350 for i in range(16))
    assert all(r.a == r.b for r in both if r.a < 8 and r.b < 8)  # the first region's own placement stays
    assert all(r.a // 4 == r.b // 4 or r.b >= 8 for r in both) and sum(r.b == 15 for r in both) > counts[15] * 1.8


def brute_fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def test_simhash(docs, none, rows):
    out = [r for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None]
    named = [(d, t) for d, t, *_ in rows if d is not None]
    fps = [brute_fingerprint(t) for _, t in named]
    expected = sorted((d, f, c) for (d, _), f, c in zip(named, fps, classes([d for d, _ in named], fps), strict=True))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == expected
    assert simhash.near_duplicates(none).count() == 0
    clashing = docs.selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS row", "4 AS hash", "5 AS _hash", "6 AS text_hash")
    more = simhash.one_of_each(clashing)
    assert more.columns == clashing.columns and {tuple(r)[5:] for r in more.collect()} == {(1, 2, 3, 4, 5, 6)}
    assert simhash.near_duplicates(clashing).count() == len(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in expected})


def test_simhash_long_and_short_texts():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 70_000):
        text = " ".join(rng.choice(WORDS) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_covering_masks_and_crowded_buckets(spark, monkeypatch):
    keep = [sum(1 << b for b in m) for m in simhash.masks(list(range(64)))]
    rng = random.Random(2)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(d & m == 0 for m in keep)
    monkeypatch.setattr(simhash, "CROWDED", 5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) % (1 << 64) for _ in range(300)})
    values = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    roots = {r.node: r.root for r in components.connected(simhash.near_links(values)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == classes(list(range(len(fps))), fps)


def test_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(120)], "k long, v long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    got = common.spread_join(left, right, "k", "n")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and sorted((r.k, r.v, r.n) for r in got.collect()) == sorted((r.k, r.v, r.n) for r in left.join(right, "k").collect())


def test_simhash_by_other_joins(spark, docs, monkeypatch):
    """Crowded buckets, salted joins and hot fingerprints give the same components."""
    key = lambda r: tuple(map(str, r))
    whole = sorted(map(key, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    monkeypatch.setattr(simhash, "CROWDED", 3)
    assert sorted(map(key, simhash.near_duplicates(docs).collect())) == whole


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark, docs, none, rows):
    out = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[norm(t)].append(d)
    key = lambda r: tuple(str(x) for x in r)
    expected = []
    for d, t, *_ in rows:
        g = groups[norm(t)]
        least = min((x for x in g if x is not None), default=None)
        expected.append((d, least, len(g), d == least, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(key, out)) == sorted(map(key, expected))
    clashing = exact_dedup.deduplicate(docs.selectExpr("*", "1 AS digest", "2 AS keep_id", "3 AS kept", "'x' AS batch"), exact_dedup.DigestIndex(spark))
    assert sorted(map(key, clashing.collect())) == sorted(map(key, expected))
    assert exact_dedup.deduplicate(none, exact_dedup.DigestIndex(spark)).count() == 0


def test_digest_index_keeps_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.deduplicate(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string"), index, batch="1")
    assert {(r.doc_id, r.keep_id, r.kept) for r in first.collect()} == {(5, 5, True), (6, 6, True)}
    second = exact_dedup.deduplicate(spark.createDataFrame([(1, "a\n b"), (2, "d"), (3, "d")], "doc_id long, text string"), index, batch="2")
    assert {(r.doc_id, r.keep_id, r.kept) for r in second.collect()} == {(1, 5, False), (2, 2, True), (3, 2, False)}
    assert index.table().count() == 3
    index.forget()
    again = exact_dedup.DigestIndex(spark.newSession(), name="opened_again", path=index.path)
    third = exact_dedup.deduplicate(again.spark.createDataFrame([(9, "c "), (8, "c"), (7, "new")], "doc_id long, text string"), again)
    assert again.buckets == 4 and {(r.doc_id, r.keep_id, r.kept) for r in third.collect()} == {(9, 9, True), (8, 6, False), (7, 7, True)}
    assert {r.batch for r in again.table().where("keep_id < 7").collect()} == {"1", "2"} and again.table().count() == 5
    index = again
    plan = index.unseen(spark.createDataFrame([("x",)], "digest string"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan


def test_line_dedup(spark, none):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lines = [rng.choice(["shared everywhere", " shared everywhere ", "", f"own line {i}", f"of a few {i % 9}", "on half " + str(i % 3)]) for _ in range(rng.randint(0, 9))]
        rows.append((i if i % 50 else None, "\n".join(lines), "en", f"s{i % 15}" if i % 40 else None, 1))
    rows += [(1, None, "en", "s1", 0), rows[7], rows[7]]
    clashing = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(("_hash", "_lines", "_removed", "n_lines", "row", "pos", "h1", "site"))))
    got = line_dedup.without_boilerplate(clashing.repartition(4), sites=6)
    assert got.columns == [*none.columns, "_hash", "_lines", "_removed", "row", "pos", "h1", "site", "n_lines", "n_removed"]
    assert {(r._hash, r._lines, r.row, r.site) for r in got.collect()} == {(0, 1, 4, 7)}
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            sites[bare(line)].add(s)
    expected = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not bare(x) or len(sites[bare(x)]) < 6]
        expected.append((str(d), "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect()) == sorted(expected)
    assert line_dedup.without_boilerplate(none).count() == 0


def test_line_dedup_by_salted_join(spark, monkeypatch):
    rows = [(d, "\n".join(["everywhere", f"own {d}", f"some {d % 20}"]), "en", f"s{d % 40}", 1) for d in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = line_dedup.without_boilerplate(docs, sites=5).collect()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(line_dedup.without_boilerplate(docs, sites=5).collect()) == sorted(whole) and {r.n_removed for r in whole} == {1}


def brute_tiles(item, doc, shortest):
    """Longest unmarked common runs, again and again."""
    fi, fd, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and fi[i + k] and fd[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                best = max(best, (k, -j, -i))
        k, j, i = best[0], -best[1], -best[2]
        if k < shortest:
            return total
        for x in range(k):
            fi[i + x] = fd[j + x] = False
        total += k


def test_decontamination(spark, none):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(3, 40))]) for i in range(12)]
    rows = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 2:
            _, item = rng.choice(items)
            pieces = [item[a : a + 8] for a in range(0, len(item), 8)]
            rng.shuffle(pieces)
            at = rng.randint(0, len(words))
            for p in pieces:
                words[at:at] = p
        rows.append((d, " ".join(w.upper() + rng.choice(["", ",", "."]) if rng.random() < 0.3 else w for w in words), "en", "s", 1))
    rows += [(None, None, None, None, None), rows[1]]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("coverage", F.lit(1)).withColumn("n_items", F.lit("a")).repartition(3)
    got = {(r.doc_id, r["text"]): r for r in decontamination.contamination(docs, benchmark).collect()}
    for d, t, *_ in rows:
        words = re.findall(r"\w+", (t or "").lower())
        shares = {i: brute_tiles(w, words, 5) / len(w) for i, w in items if len(w) >= 5}
        r = got[d, t]
        assert r.n_items == sum(s >= 0.8 for s in shares.values())
        assert r.coverage == pytest.approx(max(shares.values())) and (r.item_id is None) == (r.coverage == 0)
    assert decontamination.contamination(none, benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.limit(0)).where("n_items = 0").count() == len(rows)


def test_decontamination_by_join(spark, none, monkeypatch):
    """A benchmark too large to broadcast gives the same rows."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i if i % 7 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 30)))) for i in range(30)]
    items += [items[3], (50, None), (51, "")]
    rows = [(d, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), *(rng.choice(items)[1] or "").split(), "end"]), "en", "s", 1) for d in range(80)]
    rows += [(None, None, None, None, None), rows[1], rows[1], (5, "", "en", "s", 0)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit("x")).withColumn("k1", F.lit(1)).repartition(3)
    key = lambda r: tuple(map(str, r))
    whole = decontamination.contamination(docs, benchmark)
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    joined = decontamination.contamination(docs, benchmark)
    assert joined.columns == whole.columns == [*SCHEMA_NAMES, "k1", "n_items", "item_id", "coverage"]
    assert sorted(map(key, joined.collect())) == sorted(map(key, whole.collect())) and sum(r.n_items for r in whole.collect()) > 20
    assert decontamination.contamination(none, benchmark).count() == 0


def test_tiling_of_repeated_words_is_fast():
    item, doc = np.array([1, 2] * 3000, np.uint64), np.array([2, 1] * 3000, np.uint64)
    tiles = decontamination.tile(item, doc, np.zeros(0, np.int64))
    assert sum(t[2] for t in tiles) >= 5999


def test_toxicity(spark, none):
    rng = random.Random(7)
    bad = ["idiot", "moron", "scum", "clown"]
    plain = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for d in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if d % 6 == 0:
            for w in rng.sample(bad, 2):
                if d % 36 == 0:
                    w = rng.choice([w.replace("o", "0").replace("i", "1"), " ".join(w), w.replace("o", "ooo").replace("u", "uuuu")])
                words.insert(rng.randint(0, len(words)), w)
        rows.append((d, " ".join(words), "en", "s", 1))
        marks.append((d, 1, int(d % 6 == 0)))
    rows += [(None, None, None, None, None), (5000, "", "en", "s", 0), rows[0]]
    docs, labels = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    held = toxicity.held_out(F.col("doc_id"))
    out = toxicity.scored(docs.withColumn("toxicity", F.lit(0)), labels, ~held).withColumn("held", held).collect()
    assert len(out) == len(rows) and all(0 <= r.toxicity <= 1 for r in out)
    judged = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 700]
    wrong = [r for r in judged if (r.toxicity >= 0.7) != (r.doc_id % 6 == 0)]
    assert len(judged) > 150 and len(wrong) <= 2, [(r.doc_id, r.toxicity, r["text"][:80]) for r in wrong]
    assert len({round(r.toxicity, 12) for r in out if not r["text"]}) == 1
    assert toxicity.scored(none, labels).count() == 0
    assert {r.toxicity for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}


def test_restoring_disguised_words():
    words = Counter({"idiot": 30, "loser": 30, "stupid": 30, "hello": 20, "good": 20, "letter": 20, "moving": 10})
    fix = toxicity.Restorer(toxicity.CharacterModel(words))
    for given, meant in (("1d10t", "idiot"), ("l0$er", "loser"), ("s t u p i d", "stupid"), ("st*pid", "stupid"), ("looooser", "loser"), ("i.d.i.o.t", "idiot"), ("good letter", "good letter"), ("goooood", "good")):
        assert fix(given) == meant
    assert fix("mail x@y.org, 1999 and http://a.b/c1d") == "mail x@y.org, 1999 and http://a.b/c1d"


def test_long_disguises():
    words = Counter({"loser": 30, "idiot": 30, "hello": 20})
    fix = toxicity.Restorer(toxicity.CharacterModel(words))
    for n in (3, 34, 45, 500):
        assert fix("l" + "o" * n + "ser") == "loser" and fix("1d" + "1" * n + "ot") == "idiot"
    assert fix("1d10t" * 20) == fix("1d10t" * 20) and fix(" ".join("idiot" * 12)).replace(" ", "") == "idiot" * 12


def test_decoding_finds_what_the_model_alone_misses(spark):
    """Held-out texts whose toxic words are all disguised, scored by one model with and without the restorer."""
    rng = random.Random(18)
    bad = ["idiot", "moron", "scumbag", "loser"]
    plain = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    hide = [lambda w: w.replace("o", "0").replace("i", "1").replace("s", "$"), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: ".".join(w)]
    text = lambda extra: " ".join([*(rng.choice(plain) for _ in range(15)), *extra, *(rng.choice(plain) for _ in range(5))])
    rows = [(d, text(rng.sample(bad, 2) if d % 3 == 0 else []), int(d % 3 == 0)) for d in range(600)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t, _ in rows], SCHEMA)
    restorer, scorer = toxicity.fit(docs, spark.createDataFrame([(d, 1, x) for d, _, x in rows], "doc_id long, quality int, toxic int"))
    hidden = [text([rng.choice(hide)(w) for w in rng.sample(bad, 2)]).encode() for _ in range(100)]
    clean = [text([]).encode() for _ in range(100)]
    caught = (scorer(toxicity.restored(hidden, restorer)) >= toxicity.THRESHOLD).sum()
    without = (scorer(hidden) >= toxicity.THRESHOLD).sum()
    assert caught >= 90 and without <= 60 and (scorer(toxicity.restored(clean, restorer)) >= toxicity.THRESHOLD).sum() <= 3, (caught, without)


def test_suspecting_all_that_is_restored(monkeypatch):
    words = Counter({"idiot": 30, "loser": 30, "stupid": 30, "hate": 30, "dumbass": 20, "kill": 30, "foo": 20, "scum": 20, "größe": 20, "good": 20})
    fix = toxicity.Restorer(toxicity.CharacterModel(words))
    hidden = ["hat3", "dumb455", "f001", "scum8", "\"1diot\"", "x,1diot", "\t1diot", "k i l l,", "k-i-l-l!", "(k.i.l.l)", "g r ö ß e", "SoOo", "lOoOser", "größßße", "ÖÖöl", "abc(!", "st*pid", "\u212akKill", "!diot", "idi0t!!", "ki||", "los(1"]
    rng = random.Random(3)
    hidden += ["".join(rng.choice("abeioöÖOK013459@$!|+(*.-_ ,'\"") for _ in range(rng.randint(3, 12))) for _ in range(4000)]
    changed = [t for t in hidden if fix(t.lower()) != t.lower()]
    assert len(changed) > 300 and {"hat3", "\"1diot\"", "k i l l,", "k-i-l-l!", "SoOo"} <= {*changed}
    plain = b"nothing hidden here, is there? (no!)"
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(toxicity, "SUSPECT_BYTES", most)
        for t in changed[:: 1 if most == 50 else 10]:
            for batch in ([t], [t, "a"], ["a", t], ["", t, ""], ["plain words", t, "", "plain words"]):
                assert toxicity._suspects([x.encode() for x in batch])[batch.index(t)], (t, batch)
        assert toxicity._suspects([plain, b"hat3", plain, b"", b"3", b"a", b"f001"]).tolist() == [False, True, False, False, False, False, True]
    assert toxicity.restored([t.encode() for t in changed], fix) == [fix(t.lower()).encode() for t in changed]


def test_registered_lm_order(spark):
    """The word after a pair seen only in one order tells a trigram model, and no bigram model, the texts apart."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["a x b", "c x d"] * 20)] + [(100, "a x b", "en", "s", 1), (101, "a x d", "en", "s", 1)]
    out = {r.doc_id: r.score for r in lm_scoring.scored(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") >= 100).collect()}
    assert lm_scoring.ORDER >= 3 and out[100] > out[101] + 0.3


def lm_row(texts, flags=None):
    joined = "".join(texts).encode()
    return {"ids": np.arange(len(texts)).tobytes(), "flags": np.array(flags or [0] * len(texts), np.uint8).tobytes(), "sizes": np.array([len(t.encode()) for t in texts]).tobytes(), "texts": pa.compress(joined, codec="zstd", asbytes=True), "n_bytes": len(joined)}


def test_lm_counts_as_numbered():
    part = lm_scoring.Part(lm_row(["a b a b c", "", "b a b", "a b c a"], [0, 0, 1, 2]))
    _, _, _, word = part.words()
    lone = word == word[5]  # c
    for size in (2, 3):
        found, counts, shared = part.counted(size, lone)
        at, number, one = part.distinct(size)
        assert len(one) == len(found) and (found[1:] > found[:-1]).all()
        grams = part.grams(size)[1]
        assert (grams == found[number]).all() and counts.tolist() == np.bincount(number[~part.held[part.owner[at]]], minlength=len(found)).tolist()
        assert shared.tolist() == [not lone[i - size + 1 : i + 1].any() for i in one.tolist()]


def test_lm_words_of_one_hash_are_split(monkeypatch):
    """Words whose 64 bits agree are told apart by their checks, in a part and in a bucket."""
    keys, checks = np.array([7, 5, 7, 7, 5], np.uint64), np.array([1, 0, 2, 1, 0], np.uint16)
    first, number, n = lm_scoring.numbered(keys, checks)
    assert keys[first].tolist() == [5, 7, 7] and checks[first].tolist() == [0, 1, 2] and number.tolist() == [1, 0, 2, 1, 0] and n.tolist() == [2, 2, 1]
    sent = lambda part, check, count: {"bucket": 0, "part": part, "size": 1, "grams": lm_scoring.pack(np.array([9], np.uint64)), "checks": lm_scoring.pack(np.array([check], np.uint16)), "counts": lm_scoring.pack(np.array([count], np.uint32)), "n": 1}
    rows = lm_scoring._sum(pa.Table.from_pylist([sent(1, 4, 10), sent(2, 6, 3), sent(3, 4, 1)], schema=lm_scoring._arrow(lm_scoring._SENT))).to_pylist()
    assert [lm_scoring.unpack(r["totals"], np.uint64, 1)[0] for r in rows] == [2 * 11 + 1, 2 * 3, 2 * 11 + 1] and (rows[0]["tokens"], rows[0]["kinds"]) == (14, 2)
    hasher = WordHasher()
    hasher.hash([b"abc cab xyz", b"ABC"], check=True)
    assert hasher.checks[0] == hasher.checks[1] == hasher.checks[3] != hasher.checks[2]


def test_lm_pieces_carry_the_state(monkeypatch):
    """A long text walked in pieces scores as in one."""
    rng = random.Random(14)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (700, 3, 0, 64, 65)]
    for order in (1, 2, 3, 4):
        part = lm_scoring.Part(lm_row(texts, [0, 1, 0, 0, 1]))
        totals = {1: part.words()[2].astype(np.uint64)} | {k: part.counted(k, np.zeros(len(part.tokens), bool))[1].astype(np.uint64) for k in range(2, order + 1)}
        tokens, kinds = int(totals[1].sum()), len(totals[1])
        whole = lm_scoring.BackoffAutomaton(part, totals, tokens, kinds, order).walk(part)
        monkeypatch.setattr(lm_scoring, "PIECE", 7)
        assert lm_scoring.BackoffAutomaton(part, totals, tokens, kinds, order).walk(part).tolist() == whole.tolist()
        monkeypatch.undo()


def test_lm_scoring(spark, docs, none, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 2000)
    monkeypatch.setattr(lm_scoring, "BUCKET_GRAMS", 200)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for order in (2, 3):
        grams, n, kinds = Counter(), 0, Counter()
        for d, t, *_ in rows:
            if not held(d):
                seq = ["<s>", *words(t), "</s>"]
                kinds.update(seq[1:])
                for k in range(1, order + 1):
                    grams.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
        n, v = sum(kinds.values()), len(kinds)

        def p(history, w):
            if not history:
                return (kinds[w] + 1) / (n + v + 1)
            lower, c = p(history[1:], w), grams[history]
            mass = lm_scoring.STRENGTH * c**lm_scoring.SPREAD
            return (grams[(*history, w)] + mass * lower) / (c + mass) if c else lower

        expected = []
        for d, t, *_ in rows:
            seq = ["<s>", *words(t), "</s>"]
            base = sum(math.log10((kinds[w] + 1) / (n + v + 1)) for w in seq[1:])
            score = sum(math.log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
            expected.append((str(d), held(d), len(seq) - 1, sum(kinds[w] > 0 for w in seq[1:]), n, round(base, 6), round(score, 6)))
        got = lm_scoring.scored(docs, held_out, order=order).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(expected)
        assert sum(10 ** math.log10(p(("stone",), w)) for w in [*kinds, "unseen"]) == pytest.approx(1)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 0.1)  # without a bound this asks for more buckets than Spark allows
    monkeypatch.setattr(lm_scoring, "BUCKET_GRAMS", 0.01)
    monkeypatch.setattr(lm_scoring, "MOST_BUCKETS", 8)
    again = lm_scoring.scored(docs, held_out).collect()
    assert sorted((str(r.doc_id), r.n_known, round(r.score, 6)) for r in again) == sorted((e[0], e[3], e[6]) for e in expected)
    assert lm_scoring.scored(none, held_out).count() == 0
    clashing = docs.selectExpr("*", "true AS held_out", "1 AS score", "2 AS n_tokens", "3 AS part")
    assert lm_scoring.scored(clashing, F.lit(False)).count() == len(rows)


def test_html_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name of the paper</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></nav>'
        '<script>var x="<p>no</p>";</script><article><h1>Head&amp;line</h1><p>First <b>bold</b>\n  words &eacute; of the text that is long enough.<div class="ad">Buy this now, the best offer for all of you.</div><p>Short.</p></article>'
        '<section id="comments"><p>Reader says that this is a very long and thoughtful comment on it.</p></section><footer>&copy; 2020</footer>'
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<p>just a plain paragraph with quite a lot of words in it, and no frame"), (1, "u", page), (5, "u", "<div" * 3), (6, "u", "<p>x</p>" * 3000)]
    out = html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    texts = [r["text"] for r in out]
    assert texts[0] == texts[4] == "Head&line First bold words é of the text that is long enough. Short."
    assert texts[1] == texts[2] == "" and texts[3].startswith("just a plain") and len(out) == 7
    assert html_extraction.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0


LONG = "A long and winding paragraph of the article that tells the reader quite a lot of things about the subject."
LEGAL = "Copyright law protects works of authors, and a notice tells who holds these rights in a work and since which year it does so."
TEMPLATES = {
    "mathematics": (f"<article><h1>Title</h1><p>{LONG}</p><math><mi>x</mi><mo>=</mo><mn>2</mn></math><svg><text>Label</text></svg><p>{LONG}</p></article>", f"Title {LONG} x=2Label {LONG}"),
    "state class": (f'<body><article class="post comments-open"><h1>T</h1><p>{LONG}</p><p>Short.</p></article></body>', f"T {LONG} Short."),
    "named page": (f'<body><nav><a href=x>Home</a></nav><div class="page tags-page"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></body>', f"T {LONG} {LONG}"),
    "page in a form": (f'<body><form action="x"><nav><a href=x>Home</a></nav><h1>T</h1><p>{LONG}</p><p>{LONG}</p><select><option>One<option>Two</select></form></body>', f"T {LONG} {LONG}"),
    "law": (f"<body><div><p>{LONG}</p><p>{LEGAL}</p><p>{LONG}</p></div></body>", f"{LONG} {LEGAL} {LONG}"),
    "recipe": (f"<body><nav><ul><li><a href=1>Home</a><li><a href=2>Recipes</a></ul></nav><div><h1>Bread</h1><p>{LONG}</p><ul><li>Flour</li><li>Salt</li><li>Two eggs</li></ul><p>{LONG}</p></div><footer>&copy; 2020 X</footer></body>", f"Bread {LONG} Flour Salt Two eggs {LONG}"),
    "cookies": (f"<body><div>Please enable cookies</div><div><h1>T</h1><p>{LONG}</p></div></body>", f"T {LONG}"),
    "comments": (f'<body><main><article class="post"><header class="entry-header"><h1>T</h1><p class=byline>By Ann</p></header><div class="entry-content"><p>{LONG}</p></div><footer class="entry-footer">Tags: <a href=1>a</a></footer></article><section id="comments" class="comments-area"><h2>3 thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><footer class="comment-meta">Bob says</footer><p>{LONG} {LONG}</p></article></li></ol></section></main><aside class="widget-area"><h3>Recent</h3><p>{LONG}</p></aside></body>', f"T By Ann {LONG}"),
    "table": (f"<table><tr><td><a href=1>Home</a></td></tr><tr><td>{LONG}</td></tr></table>", LONG),
    "hidden": (f'<article><p>{LONG}</p><div style="display:none"><p>{LONG} hidden</p></div></article>', LONG),
    "letter": (f'<div id="content"><p>{LONG}</p><form class="newsletter"><p>Get our letter every week in your box.</p><button>Go</button></form><p>{LONG}</p></div>', f"{LONG} {LONG}"),
    "no script": (f"<html><head><title>My title</title></head><body><noscript>You need to enable JavaScript to run this app.</noscript><div><p>{LONG}</p></div></body>", LONG),
}


def test_templates(spark):
    rows = [(i, "u", p) for i, (p, _) in enumerate(TEMPLATES.values())]
    out = {r.page_id: r["text"] for r in html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: t for i, (_, t) in enumerate(TEMPLATES.values())}


@pytest.mark.parametrize("name", ["social-history", "alert-level", "share-prices", "banner-year", "search-and-rescue", "login-guide", "menu-of-the-day", "cookie-recipe"])
def test_long_prose_outweighs_a_name(name):
    p = f"<p>{LONG} {LONG} {LONG}</p>"
    found = html_extraction.main_text(f"<nav><a href=1>Home</a></nav><article><h1>T</h1>{p}<div class='{name}'>{p}{p}</div>{p}</article>")
    assert found.count(LONG) == 12
    assert html_extraction.main_text(f"<div class='{name}'>{p}{p}</div><div class='{name}-2'>{p}</div>").count(LONG) == 9
    assert html_extraction.main_text(f"<article>{p}</article><div class='comment-list'><div class=comment>{p}</div></div>").count(LONG) == 3


def test_site_header_goes():
    page = f"<body><header><h1>Site Name</h1><p>Your daily paper</p></header><main><h2>Title</h2><p>{LONG}</p></main></body>"
    assert html_extraction.main_text(page) == f"Title {LONG}"


def test_the_cut_decides():
    """List items that lean to boilerplate by themselves stay with the paragraphs around them; without edges they would go."""
    found = html_extraction.labelled(TEMPLATES["recipe"][0])
    alone = [t for t, odds, _ in found if odds > 0]
    assert [t for t, odds, keep in found if keep and odds <= 0] == ["Flour", "Salt", "Two eggs"] and "Flour" not in alone
    lonely = html_extraction.labelled("<nav><a href=1>Home</a></nav><div><div><b>Flour</b></div></div>")
    assert [keep for _, _, keep in lonely] == [False, False]


def test_pages_by_brute_force():
    """Random pages: of all labellings, the extracted one has the least cost."""
    rng = random.Random(17)
    soft = lambda x: math.log1p(math.exp(x))
    flips = 0

    def piece(depth: int) -> str:
        kind = rng.choice(["p", "li", "div", "h2", "nav", "aside", "article", "section", "div class=ad", "div id=content", "footer", "ul", "form"])
        inner = "".join(piece(depth + 1) for _ in range(rng.randint(1, 2))) if depth < 3 and kind.split()[0] not in ("p", "h2", "li") else " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 12, 30]))) + rng.choice(["", "."])
        return f"<{kind}>{inner}</{kind.split()[0]}>"

    for _ in range(150):
        page = "".join(piece(0) for _ in range(rng.randint(1, 4)))
        found = html_extraction.blocks(page)
        if len(found) > 11:
            continue
        assert [w for b in found for w in b.text.split()] == re.sub("<[^>]*>", " ", page).split()
        odds, edges = [html_extraction.evidence(b) for b in found], html_extraction.edges_between(found)
        cost = lambda x: sum(soft(-o) if keep else soft(o) for o, keep in zip(odds, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        labels = [keep for _, _, keep in html_extraction.labelled(page)]
        best = min(cost([bool(m >> i & 1) for i in range(len(found))]) for m in range(1 << len(found)))
        assert cost(labels) == pytest.approx(best)
        assert html_extraction.main_text(page) == " ".join(b.text for b, keep in zip(found, labels, strict=True) if keep)
        flips += sum((o > 0) != keep for o, keep in zip(odds, labels, strict=True))
    assert flips > 10


def test_minimum_cut_is_least():
    rng = random.Random(8)
    soft = lambda x: math.log1p(math.exp(x))
    for _ in range(60):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(soft(-o) if keep else soft(o) for o, keep in zip(odds, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extraction.minimum_cut(odds, edges)) == pytest.approx(best)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 13 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((k, *m.span()))
    return sorted(out)


def test_pii_base_spans():
    rng = random.Random(9)
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(("ab@.", "0123456789", "+() -.", "@é1."))) for _ in range(rng.randint(0, 60)))
        assert sorted(pii.base_spans(t)) == brute_spans(t)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_pii_disjoint_spans():
    rng = random.Random(15)
    for _ in range(300):
        spans = [(0, a, a + rng.randint(1, 6)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 8)))]
        held = pii.Spans(spans)
        for a in range(64):
            for b in range(a + 1, 66):
                assert held.overlaps((1, a, b)) == any(a < e and s < b for _, s, e in spans)


def test_pii_judges_forms_it_never_wrote(spark):
    """Recall and precision on forms and contexts that the trees' own examples don't have."""
    rng = random.Random(16)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda: next(c for c in iter(lambda: "5" + digits(15), "") if pii.luhn(c))
    noise = ["see page 12", "order 77-1234-99", "version 10.2.3.400", "at noon", "in 1999-2004", "sum 12 345 678", "look at it. Then go", "ref 2024/11/05", "id 123456789012", "a quick look"]
    rows = []
    for d in range(600):
        bits = [f"mail ann.{d}@host{d % 7}.example.org", f"host 10.{d % 250}.3.{d % 99}", f"card {card()}", f"call +44 20 7946 {1000 + d}", f'api_key = "{rng.getrandbits(160):040x}"', *rng.sample(noise, 3)]
        rng.shuffle(bits)
        rows.append((d, " , ".join(bits)))
    judge = pii.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    made = {
        0: lambda: f"{rng.choice(['joe', 'kim.lee', 'p_ray'])} {rng.choice(['[AT]', '{at}', '(AT)'])} {rng.choice(['mailbox', 'web-host'])} {rng.choice(['[DOT]', '(DOT)'])} {rng.choice(['com', 'net', 'de'])}",
        1: lambda: f"{rng.randrange(256)}{'(dot)'}{rng.randrange(256)}{'[dot]'}{rng.randrange(256)}{'[.]'}{rng.randrange(256)}",
        2: lambda: (lambda c: f"{c[:4]}/{c[4:8]}_{c[8:12]}/{c[12:]}")(card()),
        3: lambda: f"({digits(3).replace('0', '4')}) 555.{1000 + rng.randrange(8999)}",
        4: lambda: f"{rng.getrandbits(128):032x}",
    }
    lead = {0: "write to ", 1: "server ", 2: "visa ", 3: "tel ", 4: "password: "}
    for kind, make_one in made.items():
        hit = 0
        for _ in range(60):
            s = make_one()
            text = f"Some words before, {lead[kind]}{s} and some after."
            at = text.index(s)
            hit += any(k == kind and abs(a - at) <= 1 and abs(b - at - len(s)) <= 1 for k, a, b in judge.spans(text)[1])
        assert hit >= 45, (pii.KINDS[kind], hit)
    wrong = sum(len(judge.spans(f"We {rng.choice(noise)} and {rng.choice(noise)}, {rng.choice(['isbn 978 3 16 148410 0', 'total 4 000 000', 'lines 10 - 20 - 30', 'a.b.c and so on'])}.")[1]) for _ in range(200))
    assert wrong <= 10


def test_pii(spark, none):
    rng = random.Random(10)
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)), "") if pii.luhn(c))
    rows = []
    for d in range(400):
        bits = ["word " * rng.randint(1, 5), f"ann.{d}@mail{d % 9}.example.com", f"{d % 250}.{d % 99}.7.1", card(), f"+1 ({200 + d}) 555-{1000 + d}", f"order {d}-{d * 7}-22"]
        rows.append((d, " and ".join(rng.sample(bits, rng.randint(1, 5))), "en", "s", 1))
    rows += [(None, None, None, None, None), (900, f"call +1 (312) 555-1064 {card()} now", "en", "s", 1), rows[0]]
    out = pii.found(spark.createDataFrame(rows, SCHEMA).withColumn("pii", F.lit(1)).withColumn("text_", F.lit(1)).repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        base = brute_spans(r["text"] or "")
        assert r.pii.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert (r.pii.n_email, r.pii.n_ip, r.pii.n_card, r.pii.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert not base or set(pii.listed(base).split(",")) <= set(r.pii.spans.split(","))
        assert r.pii.n_spans == len([x for x in r.pii.spans.split(",") if x]) >= len(base)
    assert "(312)" not in next(r.pii.redacted for r in out if r.doc_id == 900)
    assert pii.found(none).count() == 0


def test_mixing_budgets(spark):
    leaves = [(0, "en", "a", 100), (0, "en", "b", 1000), (0, "de", "c", 50), (1, "en", "d", 1000), (2, None, "e", 10), (3, "en", None, 0)]
    df = spark.createDataFrame(leaves, "domain int, lang string, source string, tokens long")
    got = {r.source: r.given for r in mixing.leaf_budgets(df, F.lit(1000.0), 1).collect()}
    # domains: 2 holds 10 of 200 and 3 nothing; 990 is split 4:3 between 0 and 1
    assert got["e"] == pytest.approx(10) and got["d"] == pytest.approx(990 * 3 / 7) and got[None] == 0
    weighted = {r.source: r.given for r in mixing.leaf_budgets(df, F.lit(100.0), 1, (1.0,), {"en": 3.0, "de": 1.0}, {"b": 9.0, "a": 1.0}).collect()}
    assert (weighted["a"], weighted["b"], weighted["c"], weighted["d"]) == (pytest.approx(7.5), pytest.approx(67.5), pytest.approx(25), 0)
    # in domain 0, de holds 50, and a holds 100: the shortage goes to siblings
    assert got["c"] == pytest.approx(50) and got["a"] == pytest.approx(100) and got["b"] == pytest.approx(990 * 4 / 7 - 150)


def test_mixing(docs, none, rows):
    for epochs in (1, 2):
        out = mixing.mix(docs, 0.7, epochs, 3).collect()
        assert len(out) == len(rows) and {r.copies for r in out} <= set(range(epochs + 1))
        total = sum(r.tokens for r in out)
        assert abs(sum(r.tokens * r.copies for r in out) - 0.7 * total) <= 60 * len({(r.domain, r.lang, r.source) for r in out}) / 2 + 1
    assert mixing.mix(none, 0.5).count() == 0
    taken = mixing.mixture(docs, 0.7, 2, 3)
    assert taken.columns == docs.columns and taken.count() > 0
    clashing = docs.selectExpr("*", "1 AS _hash", "2 AS domain", "3 AS tokens", "4 AS row", "5 AS id", "6 AS copies", "7 AS _id")
    more = mixing.mixture(clashing, 0.7, 2, 3)
    assert more.columns == clashing.columns and {tuple(r)[5:] for r in more.collect()} == {(1, 2, 3, 4, 5, 6, 7)} and more.count() == taken.count()


def test_word_hashes():
    rng = random.Random(11)
    texts = [rng.choice([" ", "\n\t"]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))).encode() for _ in range(200)] + [b"", b"abc " * 200_000, b"q" * 700_000 + b" zz"]
    rng.shuffle(texts)
    found, counts, (heads,) = WordHasher().hash(texts, (2,))
    assert list(counts) == [len(t.split()) for t in texts]
    for hashes, cut in ((found, None), (heads, 2)):
        seen = dict(zip((w[:cut] for t in texts for w in t.lower().split()), hashes.tolist(), strict=True))
        assert all(seen[w[:cut]] == h for w, h in zip((w for t in texts for w in t.lower().split()), hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    assert len(chained(np.arange(5, dtype=np.uint64), 3)) == 3 and len(chained(np.arange(2, dtype=np.uint64), 3)) == 0
