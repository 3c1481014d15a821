"""What texts and sets have in common, against loops by hand; and that no token, pair or session becomes a shuffled row."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graph as G
from mnemospark.operators import intents as I
from mnemospark.operators import judging as J
from mnemospark.operators import runtime as R
from mnemospark.operators import texts as X
from mnemospark.plans import registry

TEXTS = [(1, "Red fox, red fox sees red"), (2, "a fox"), (3, None), (4, ""), (5, "the lazy dog's fox"), (6, "nothing here"), (7, "dog dog dog red"), (8, "Fox A")]
REFS = [(10, "red red dog"), (11, "a fox"), (12, None), (13, "dog's the the"), (14, "fox red lazy"), (15, "unseen")]


def words(text):
    return re.findall(r"[\w']+", (text or "").lower())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [2, 10_000])
@pytest.mark.parametrize("distinct", [False, True])
def test_token_f1_like_a_loop(spark, block, distinct):
    read = (lambda x: Counter(set(words(x)))) if distinct else (lambda x: Counter(words(x)))
    want = {}
    for i, text in TEXTS:
        both = [(2.0 * (read(text) & read(r)).total(), read(text).total() + read(r).total()) for _, r in REFS]
        if best := max((a / b for a, b in both if a), default=0.0):
            want[i] = best
    got = X.token_f1(spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(REFS, "ref long, text string"), distinct, block)
    assert {r.id: r.f1 for r in got.collect()} == pytest.approx(want)
    assert block == 2 or "Exchange" not in plan(got)
    assert X.token_f1(spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame([], "ref long, text string")).count() == 0


@pytest.mark.parametrize("block", [1, 10_000])
def test_most_common_like_a_loop(spark, block):
    nodes = [(i, " ".join(w for j, w in enumerate("red fox dog the lazy a sees".split()) if i % (j + 2) < 2)) for i in range(300)] + [(900, None)]
    terms = [(10, "red"), (10, "fox"), (10, "dog"), (11, "lazy"), (11, "a"), (12, "unseen"), (13, "fox")]
    want = set()
    for p in {p for p, _ in terms}:
        asked = {t for q, t in terms if q == p}
        scored = sorted((-n, i) for i, text in nodes if (n := len(asked & set(words(text)))))
        want |= {(p, i, -n, k) for k, (n, i) in enumerate(scored[:4], 1)}
    got = X.most_common(spark.createDataFrame(nodes, "id long, text string").repartition(3), spark.createDataFrame(terms, "probe long, term string"), 4, block)
    assert set(map(tuple, got.select("probe", "id", "n", "rank").collect())) == want
    assert X.most_common(spark.createDataFrame(nodes, "id long, text string"), spark.createDataFrame([], "probe long, term string"), 4).count() == 0


@pytest.mark.parametrize("name", ["entity_match_topk", "lexical_relevance"])
def test_best_nodes_are_cut_in_the_tasks_that_read_them(spark, data, name):
    found = plan(registry.queries()[name](spark, data))
    assert "MapInArrow" in found and "hashpartitioning(term" not in found and "hashpartitioning(probe#, id" not in re.sub(r"#\d+L?", "#", found)


def test_entities_are_all_terms_of_a_probe(spark, tmp_path):
    spark.createDataFrame([(1, "w0 w1"), (2, "w17 w18 w19"), (3, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = registry.queries()["entity_match_topk"](spark, str(tmp_path)).collect()
    assert sorted((r["probe"], r["id"], r["score"], r["rank"]) for r in found) == [(7, 1, 0.1, 2), (7, 2, 0.15, 1)]


def test_hash_embedding_like_a_loop(spark):
    cells = defaultdict(int)
    for i, text in [*TEXTS, (2, "again red")]:
        for w in words(text):
            d = hashlib.sha256(w.encode()).digest()
            cells[i, int.from_bytes(d[:4], "big") % 16] += 1 if d[4] % 2 == 0 else -1
    size = defaultdict(float)
    for (i, _), x in cells.items():
        size[i] += x * x
    got = X.hash_embedding(spark.createDataFrame([*TEXTS, (2, "again red"), (None, "red")], "doc_id long, text string"), 16)
    assert {(r.doc_id, r.i): r.x for r in got.collect()} == pytest.approx({k: x / size[k[0]] ** 0.5 for k, x in cells.items() if x}, abs=1e-6)
    assert "hashpartitioning(doc_id#, term" not in re.sub(r"#\d+L?", "#", plan(got))


def test_answers_meet_their_references_in_one_row(spark):
    refs = spark.createDataFrame([(1, "red fox"), (1, "Red fox sees"), (2, "A fox!"), (4, "x"), (4, "the"), (5, " ")], "id long, reference string")
    got = J.against_references(spark.createDataFrame(TEXTS, "id long, text string"), refs)
    found = {r.id: (r.exact_match, round(r.token_f1, 6)) for r in got.collect()}
    assert found[1] == (0.0, round(2 * 3 / 9, 6)) and found[2] == (1.0, 1.0) and found[4][1] == 1.0 and found[3] == found[5] == found[6] == (0.0, 0.0)
    assert "Generate" not in plan(got)


def test_jaccard_shuffles_no_pairs(spark, data):
    assert "hashpartitioning(a#, b" not in re.sub(r"#\d+L?", "#", plan(registry.queries()["entity_jaccard"](spark, data)))


def test_questions_are_read_once_and_patterns_looked_for_by_their_beginnings(spark):
    every = [p for own in I.PATTERNS.values() for p in own] + [*I.COMPLEX, *I.BEFORE, *I.AFTER]
    said = ["who is it now", "known anyhow", "what place, which people", "the reason it caused", "谁 之前", "", "Before  and\nAfter, how many", "list all", "compare both if he had", "whom", *(re.sub(r"\\b|\(\?:|\)|\?|\|.*", "", p) for p in every)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "probe long, text string")
    low = F.lower(I.question(F.col("text")))
    own = [(p, I._begins(p)) for p in every]
    row = df.select(*(F.count_if(low.rlike(p) & ~(F.lit(False) if b is None else F.exists(F.array(*map(F.lit, b)), lambda s: F.contains(low, s)))).alias(f"x{i}") for i, (p, b) in enumerate(own) if b)).first()
    assert not any(row) and sum(b is not None for _, b in own) > len(own) / 2
    found = I.analysed(df)
    kinds = {r.probe: r.kinds for r in found.collect()}
    plainly = df.select("probe", *(low.rlike("|".join(f"(?:{p})" for p in ps)).alias(n) for n, ps in I.PATTERNS.items()))
    assert all([k for k in I.PATTERNS if r[k]] == [k for k in kinds[r.probe] if k != "complex"] for r in plainly.collect())
    assert "_low" not in found.columns
    assert plan(found).count("regexp_replace") <= 2


def test_rounds_read_edges_that_were_made_once(spark):
    """Eight rounds over a chain; the edges are counted as they are made."""
    made = spark.sparkContext.accumulator(0)
    chain = spark.createDataFrame([(i, i + 1, "next", "explicit", 1.0) for i in range(12)], "source long, target long, type string, trust string, confidence double").coalesce(1)
    edges = G.oriented(chain)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = edges.count()
    rel = spark.createDataFrame([(1, i, 0.5) for i in range(13)], "probe long, node long, rel double")
    found = R.retrieve(spark.createDataFrame([(1, 0, 0.9)], "probe long, id long, score double"), edges.mapInArrow(counted, edges.schema), rel, rounds=3)
    assert found.count() == 4 and made.value == rows
