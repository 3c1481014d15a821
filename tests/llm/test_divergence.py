"""Source divergence against a plain count, its radix selection against sorting, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from mnemospark.llm import divergence as D
from mnemospark.llm import queries

SHAPE = "doc_id long, TEXT string, lang string, source string, n string, value string, term string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, most=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    seen, count, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        seen.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in seen.items() if x == lang and n >= 3]
        shares = {}
        for g in [*sources, None]:
            n = {w: sum(count[lang, s, w] for s in (sources if g is None else [g])) for w in kept}
            shares[g] = {w: 1 + 10**9 * (n[w] + 1) // (sum(n.values()) + len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for g in sources:
            pair = [(h, sum(f(shares[g][w], shares[h][w]) for w in kept)) for h in sources if h != g]
            term = [(w, f(shares[g][w], shares[None][w])) for w in kept if count[lang, g, w] and shares[g][w] > shares[None][w]]
            for part, found, n in (("pair", pair, len(pair)), ("term", term, most)):
                out += [(lang, g, part, i, v, r) for r, (i, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:n], 1)]
    return sorted(out)


def test_small_tables(spark):
    r = random.Random(3)
    words = ["Aa", "aa", "b", "ça", "É", "é", "日本", "x" * 40 + "1y", "q-q", "\U0001f600z"]
    rows = [(None, None, None), ("", "xx", "alone"), (None, "xx", "s1"), ("one two", "lone", "only"), ("one\ntwo", "lone", "only"), ("one\x00two ONE", "lone", "only")]
    rows += [(" ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "de", None]), f"s{r.choice([0, 0, 0, 1, 2, 3])}") for _ in range(80)]
    df = spark.createDataFrame([(1, *x, "n", "v", "t") for x in rows], SHAPE)
    for most in (2,):
        assert sorted(map(tuple, D.source_divergence(df, most=most).collect())) == by_hand(rows, most)
    assert D.source_divergence(df.limit(0)).collect() == []


def test_largest_equals_sorting(spark):
    r = random.Random(11)
    stem = "common beginning " * 4
    groups = {
        ("a", "ties"): [(f"{stem}{'é' * (i % 5)}{i}", 7) for i in range(900)],
        ("a", "prefixes"): [("p" * i, 3) for i in range(1, 300)] + [("z", 4)],
        ("a", "wide"): [(f"w{i}", r.choice([0, 1, r.getrandbits(r.randint(1, 60))])) for i in range(1500)],
        ("b", "few"): [(f"w{i}", i) for i in range(5)],
        ("b", "exact"): [(f"w{i:03}", i // 4) for i in range(40)],
        ("b", "zeros"): [(f"w{i:03}", 0) for i in range(90)],
    }
    df = spark.createDataFrame([(*g, i, v) for g, own in groups.items() for i, v in own], "lang string, source string, item string, value long")
    for k in (10, 39):
        got = defaultdict(set)
        for lang, source, item, value in D.largest(df, k).collect():
            got[lang, source].add((item, value))
        assert got == {g: set(sorted(own, key=lambda x: (-x[1], x[0].encode()))[:k]) for g, own in groups.items()}
    assert D.largest(df.limit(0), 5).collect() == []


def test_query_equals_sql_and_count(spark, data):
    got = sorted(map(tuple, queries.op11_source_divergence(spark, data).collect()))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{data}/documents.parquet'")
    assert got == sorted(c.execute(queries.SQL["op11_source_divergence"]).fetchall())
    assert got == by_hand([(x.text, x.lang, x.source) for x in spark.read.parquet(f"{data}/documents.parquet").collect()])
