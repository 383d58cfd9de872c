"""Operators that bring documents together, against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import aliases, components, line_dedup, parity_join, reshard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(own, size):
    n = min(size, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def mutated(rng, count=60):
    """Near copies of a few texts at all distances around the thresholds, in two hot groups."""
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (60, 140, 9)]
    out = []
    for k in range(count):
        own = list(base[k % 3])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1])] = [f"w{rng.randint(0, 400)}"]
        out.append((100 + k, " ".join(own), "en"))
    return out


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 8, 10), (2, 6, 10)])
def test_parity_join(spark, all_rows, size, num, den):
    rows = all_rows + mutated(random.Random(size))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    sets = [(i, shingles(words(t), size)) for i, t, _ in rows]
    links = [
        (a, b) for (a, x), (b, y) in itertools.combinations(sets, 2)
        if a != b and x and y and den * len(x & y) >= num * len(x | y)
    ]
    label = classes({i for i, _ in sets}, links)
    got = sorted(map(tuple, parity_join.link_components(docs, size=size, num=num, den=den).collect()))
    assert got == sorted((i, len(s), label[i]) for i, s in sets)
    assert parity_join.link_components(docs.limit(0)).count() == 0


def test_parity_keys_meet():
    """Two sets within the bound always share a key, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (8, 10), (6, 10)):
        bands = parity_join.Bands(num, den)
        for _ in range(400):
            n = int(rng.integers(1, 300))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            y = x
            for _ in range(int(rng.integers(0, n // 3 + 2))):
                more = np.unique(np.append(y, rng.integers(0, 2**63).astype(np.uint64)))
                less = np.delete(y, rng.integers(0, len(y))) if len(y) > 1 else y
                new = more if rng.random() < 0.5 else less
                common = len(np.intersect1d(x, new))
                if common * den >= num * (len(x) + len(new) - common):
                    y = new
            assert set(bands.keys(x)) & set(bands.keys(y))


def test_line_dedup(spark, all_rows):
    rng = random.Random(4)
    base = [[f"v{rng.randint(0, 300)}" for _ in range(n)] for n in (12, 40, 6)]
    extra = []
    for k in range(25):
        own = []
        for b in base:
            line = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = f"v{rng.randint(0, 300)}"
            own.append(" ".join(line))
        extra.append((200 - k, "\n".join([*own, "short one", ""]), "en"))
    rows = [r for r in all_rows if r[0] != 17] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(3)
    lines = [
        (i, k, x, shingles(words(x), 5))
        for i, t in {i: t for i, t, _ in rows}.items() if t is not None for k, x in enumerate(t.split("\n"))
    ]
    gone = {
        (i, k) for i, k, _, s in lines for j, m, _, o in lines
        if (j, m) < (i, k) and s and o and 10 * len(s & o) >= 8 * len(s | o)
    }
    got = sorted(map(tuple, line_dedup.remove_matched_lines(docs).select("doc_id", "n_lines", "n_removed", "text").collect()), key=str)
    want = []
    for i, t, _ in rows:
        own = t.split("\n") if t is not None else []
        left = [x for k, x in enumerate(own) if (i, k) not in gone]
        want.append((i, len(own), len(own) - len(left), "\n".join(left) if t is not None else None))
    assert got == sorted(want, key=str)
    assert line_dedup.remove_matched_lines(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(500, 500 + k) for k in range(1, 60)]
    rest = [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    edges = [*chain, *star, *rest, (7, 7), (None, 3), (3, None), *chain[:5]]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == classes({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


# URL filters

PAGES = [
    (1, "http://a.org/x", '<link rel="canonical" href="/y">'), (2, "https://www.a.org/y#z", ""),
    (3, "http://a.org/y?utm_source=1", '<meta http-equiv="refresh" content="0; url=https://b.net/es/1">'), (4, None, None),
    (5, "no address", "x"), (6, "https://c.org/q", "<LINK href='http://d.org/p' REL='canonical'>"), (7, "http://d.org/p", ""),
    (8, "HTTP://X.Example.com/en/1", None), (9, "https://www.example.com/en/1?q", ""), (10, "https://e.org", '<link rel=canonical href="//www.example.com/en/2">'),
    (11, "https://f.org/k", '<link rel="canonical" href="https://y.example.com/en/9">'), (12, "http://net", ""), (13, "http://a.net/fr/", ""),
    (14, "https://f.org/k?b=2&a=1", ""), (15, "https://m.f.org:443/k?a=1&utm_medium=x&b=2", '<link rel="canonical" href="http://z.net/es/">'),
    (1, "http://a.org/x", '<link rel="canonical" href="/y">'),
]
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_aliases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("old"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in aliases.judge_pages(pages, RULES).collect()}
    assert got == {
        1: ("a.org", "/x", None, "block"), 2: ("www.a.org", "/y", None, "block"), 3: ("a.org", "/y", None, "block"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("c.org", "/q", None, "allow"), 7: ("d.org", "/p", None, "allow"),
        8: ("x.example.com", "/en/1", "example.com/en/", "block"), 9: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        10: ("e.org", "", None, "allow"), 11: ("f.org", "/k", None, "block"), 12: ("net", "", None, "allow"),
        13: ("a.net", "/fr/", "net/fr/", "block"), 14: ("f.org", "/k", None, "block"), 15: ("m.f.org:443", "/k", None, "block"),
    }
    assert aliases.judge_pages(pages, RULES).count() == len(PAGES)
    more = spark.createDataFrame([("http://d.org/p", "http://a.net/fr/"), (None, "x")], "from_url string, to_url string")
    linked = {r.page_id: r.verdict for r in aliases.judge_pages(pages, RULES, links=more).collect()}
    assert linked[6] == linked[7] == "block"
    # An allowed alias outweighs a blocked one.
    both = spark.createDataFrame([("http://d.org/p", "http://a.net/fr/"), ("http://d.org/p", "http://ok.com/")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in aliases.judge_pages(pages, RULES, links=both).collect()}[7] == "allow"
    assert aliases.judge_pages(pages.limit(0), RULES).count() == 0


# Sharding


def cheapest(supply, demand, cost):
    """Least cost by trying every way to send single units."""
    if not supply:
        return 0
    best = None
    for split in itertools.product(*[range(min(supply[0], d) + 1) for d in demand]):
        if sum(split) == supply[0]:
            rest = cheapest(supply[1:], [d - s for d, s in zip(demand, split, strict=True)], cost[1:])
            own = rest + sum(s * c for s, c in zip(split, cost[0], strict=True)) if rest is not None else None
            best = own if best is None or own is not None and own < best else best
    return best


def test_min_cost_flow():
    rng = random.Random(8)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        demand = [rng.randint(0, 4) for _ in range(m)]
        supply = [0] * n
        for _ in range(sum(demand)):
            supply[rng.randrange(n)] += 1
        cost = [[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        flow = reshard.min_cost_flow(supply, demand, cost)
        assert [sum(f) for f in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == demand
        assert sum(f * c for x, y in zip(flow, cost, strict=True) for f, c in zip(x, y, strict=True)) == cheapest(supply, demand, cost)


def test_reshard(spark, docs, all_rows, tmp_path):
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    old = F.crc32(F.col("__name")) % 3
    for shares in (4, [1.0, 2.0, 0.0, 1.0], 1):
        moved, plan = reshard.reshard(table, old, "text", shares)
        rows = moved.select("doc_id", "text", "shard", "slot", "source", "moved").collect()
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((i, t or "") for i, t, _ in all_rows)
        for shard in {r.shard for r in rows}:
            own = sorted(r.slot for r in rows if r.shard == shard)
            assert own == list(range(len(own)))
        assert 0 <= plan.moved_bytes <= plan.total_bytes == sum(len((t or "").encode()) + 1 for _, t, _ in all_rows)
    even = [len(f"{k}") for k in range(4000)]
    spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text").repartition(7).write.parquet(str(tmp_path / "even"))
    got, plan = reshard.reshard(spark.read.parquet(str(tmp_path / "even")), F.crc32(F.col("__name")) % 3, "text", 8)
    sizes = [r.b for r in got.groupBy("shard").agg(F.sum(reshard.text_size("text")).alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 4 * 5 * 2 and sum(sizes) == sum(even) + 4000
    stayed = got.where("not moved").agg(F.sum(reshard.text_size("text"))).head()[0]
    assert abs(plan.total_bytes - stayed - plan.moved_bytes) <= 12 * 5
    docs.limit(0).write.parquet(str(tmp_path / "none"))
    assert reshard.reshard(spark.read.parquet(str(tmp_path / "none")), old, "text", 8)[0].count() == 0


def test_columns_named_as_helpers(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a.com/x", None, "n", "a", "b"), (2, None, "<p>", "n", "a", "b")],
        "page_id long, url string, html string, node string, allows string, blocks string",
    )
    for table in (pages, pages.limit(0)):
        judged = aliases.judge_pages(table, [("allow", "com/")])
        assert judged.where("node = 'n' and allows = 'a' and blocks = 'b'").count() == table.count()
    rows = spark.createDataFrame([(k, "x" * k, 5) for k in range(40)], "doc_id long, text string, start_row int")
    rows.write.parquet(str(tmp_path / "rows"))
    placed, _ = reshard.reshard(spark.read.parquet(str(tmp_path / "rows")), F.lit(0), "text", 3)
    assert sorted((r.doc_id, r.start_row) for r in placed.collect()) == [(k, 5) for k in range(40)]


def test_short_lines_and_copied_documents(spark):
    docs = spark.createDataFrame(
        [(1, "a b c\nd e"), (2, "A b  c\nd e"), (3, "d e f\na b c d\na b c d e"), (4, "a b c d\na b c d e\n\n a\n,"), (5, "a")],
        "doc_id long, text string",
    )
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.remove_matched_lines(docs).collect()}
    assert got == {1: (0, "a b c\nd e"), 2: (2, ""), 3: (0, "d e f\na b c d\na b c d e"), 4: (2, "\n a\n,"), 5: (1, "")}


def test_shared_blocks_over_task_borders(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 60), rng.randint(0, 40)) for _ in range(300)] + [(7, k) for k in range(4000)] + [(61, 5), (61, 5), (62, 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "key long, id long").repartition(3)
        got = parity_join._met(table).collect()
        assert parity_join._met(table.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ids = {}
    for k, i in rows:
        ids.setdefault(k, set()).add(i)
    want = sorted((k, i, min(ids[k])) for k, i in rows if len(ids[k]) > 1)
    assert sorted((r.key, r.id, r["first"]) for r in got) == want


def test_long_sets_that_meet_by_chance(spark):
    """Pairs of long sets go before the sets themselves are brought together; those around the threshold stay."""
    rng = random.Random(7)
    long = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage, base = long(300), long(2100)
    texts = [passage + long(n) for n in (700, 1300, 1500, 2000, 2100)]  # a common passage and nothing else
    for changed in range(8, 64, 4):  # a changed word takes five shingles
        own = list(base)
        for at in rng.sample(range(0, 2000, 25), changed):
            own[at] = f"u{rng.randrange(10**9)}"
        texts.append(own + long(rng.choice([0, 100])))
    rows = [(k, " ".join(own)) for k, own in enumerate(texts)]
    sets = [(k, shingles(own, 5)) for k, own in enumerate(texts)]
    pairs = [(a, b, len(x & y) * 10 >= len(x | y) * 8) for (a, x), (b, y) in itertools.combinations(sets, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = parity_join.Bands(8, 10)
    words_ = ", ".join(f"s{k} long" for k in range(parity_join.SKETCH))
    schema = f"id long, n long, d1 long, d2 long, {words_}, wide array<long>, least array<long>, keys array<long>"
    known = parity_join._per_row(docs, 5, schema, parity_join._profile(bands))
    asked = spark.createDataFrame([p[:2] for p in pairs], "a long, b long")
    left = set(map(tuple, parity_join._within(asked, known, 8, 10).collect()))
    linked = {p[:2] for p in pairs if p[2]}
    assert 0 < len(linked) < len(pairs) and linked <= left
    assert not any(a < 5 for a, _ in left)
    found = {r.id: r.component_id for r in parity_join.link_components(docs).collect()}
    assert found == classes(range(len(texts)), linked)
