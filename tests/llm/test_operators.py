"""Each operator against a brute-force version or the library itself, and its edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import ann, bpe, chat, line_dedup, lm_score, minhash, packing, quality_classifier, quality_rules, stats, token_count
from mnemospark.llm.common import components, held_out, tokenizer_path

SHAPE = "doc_id long, text string, source string, n_words string, kept string, score string, rule string, component_id string, _s string, _w string, n_lines string"
PASSAGE = " ".join(f"passage{i}" for i in range(55))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "a b c " * 30), (6, "a b c " * 30), (7, "x" * 3000), (None, "a null id " + PASSAGE), (None, None),
    (8, "Ünïcödé Straße ΑΣ Σ <|endoftext|>a<s> ▁b  c  d é it's 'S 12 3!!\x1cq"), (9, "a b c " * 30), (10, " ".join(f"w{i % 700}" for i in range(30_000))), (11, f"first line\n{PASSAGE}\nlast"), (12, f"{PASSAGE}\nother words\n\nend"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", "n", "k", "sc", "r", "c", "_", "__", "l") for i, t in ODD], SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def words(text):
    return (text or "").encode().split()


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd, real):
    for df, own in ((odd, ODD), (real, [(r.doc_id, r.text) for r in real.collect()])):
        got = stats.with_stats(df.select("doc_id", "text")).select("doc_id", "text", "_s.*").collect()
        assert len(got) == len(own)
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)


def test_quality_rules(spark, odd, none, real, labels):
    got = quality_rules.quality_rules(odd, labels)
    assert got.count() == len(ODD) and {"source", "kept", "base_failed"} <= set(got.columns)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got.collect())
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.learn(real, labels.limit(0)) == []
    judged = quality_rules.quality_rules(real, labels).join(labels, "doc_id").where(held_out(F.col("doc_id")) & ~F.col("base_failed")).collect()
    assert len(judged) > 30 and sum(r.kept == (r.quality == 1) for r in judged) >= 0.9 * len(judged)  # 300 labels only


def test_rules_are_ordered_conditionals(spark):
    df = spark.createDataFrame([(0.1, 5.0), (0.9, 5.0), (0.9, 1.0), (None, 1.0)], "symbol_ratio double, log_words double")
    rules = [(("symbol_ratio", ">", 0.5), ("log_words", ">", 3.0)), (("log_words", "<=", 2.0),)]
    assert [r[0] for r in df.select(quality_rules.rule_column(rules)).collect()] == [0, 1, 2, 2]


def test_quality_classifier(spark, odd, none, real, labels):
    got = quality_classifier.quality_scores(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality_classifier.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    judged = quality_classifier.quality_scores(real, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(judged) > 50 and sum(r.predicted == r.quality for r in judged) >= 0.93 * len(judged)


def test_isotonic():
    y = quality_classifier.isotonic(np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.array([1.0, 1, 1, 2, 1]))
    assert np.allclose(y, [0.1, 0.35, 0.35, 0.35, 0.9])


def test_token_counts(spark, odd, none, real):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for df in (odd, real):
        for r in token_count.token_counts(df).collect():
            t = r.text or ""
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(sp.encode(t))) and r.over_limit == (r.n_tokens > 4096)
    assert token_count.token_counts(none).count() == 0
    small = token_count.Lengths("piece_bpe_32k.model", {}, most=3)
    assert small.count(["a bb ccc dddd eeeee", " x  y ", "▁"]) == [len(sp.encode(t)) for t in ("a bb ccc dddd eeeee", " x  y ", "▁")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_bpe(spark, odd, none, real, tokenizer):
    for df in (odd, real):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.encode_documents(df, parts=3).collect())) == want
    assert bpe.encode_documents(none).count() == 0


def test_decoding_joins_pieces(spark, tokenizer):
    ids = [tokenizer.encode(t).ids for t in ("the cat sat", "", "it's 12")]
    pieces = spark.createDataFrame(list(enumerate(bpe.Words("word_bpe_49k.json").pieces())), "id int, piece string")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(df, pieces).collect()} == {i: tokenizer.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_small_caches_change_nothing(tokenizer):
    texts = [t for _, t in ODD]
    few = bpe.Words("word_bpe_49k.json", most=5)
    assert [x.tolist() for x in few.ids(pa.array(texts), rows=2)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark, odd, none, real, tokenizer):
    for df, group in ((odd, 4), (real, 300)):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
            for i in range(0, len(ids), 2048):
                own = ids[i : i + 2048]
                want[r.doc_id, i, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()), len(ids)] += 1
        got = packing.pack(df, group=group).collect()
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
        seen = defaultdict(list)
        for r in got:
            seen[r.sequence_id].append((r.offset, r.length))
        for own in seen.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert sum(r.length for r in got) > 0.98 * 2048 * len(seen)
    assert packing.pack(none).count() == 0


def test_best_fit_is_tightest():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    left = []
    for n, (s, o) in zip(lengths, packing.best_fit(lengths, 100), strict=True):
        fits = [c for c in left if c >= n]
        if fits:
            assert left[s] == min(fits) and o == 100 - left[s]
        else:
            assert s == len(left) and o == 0
            left.append(100)
        left[s] -= n


def linked(texts, size, percent):
    sets, top = {}, {}
    for i, t in texts.items():
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i], top[i] = ({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()), i

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("size", "percent", "few"), [(3, 85, 16), (5, 80, 1), (3, 70, 1)])
def test_near_duplicates(spark, odd, none, size, percent, few):
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(2000)]
    texts, root = {}, [vocabulary[i] for i in rng.integers(0, 2000, 120)]
    for n in range(150):  # a large group of copies, near and nearer
        own = list(root)
        for k in rng.integers(0, 120, int(rng.integers(0, 9))):
            own[k] = vocabulary[int(rng.integers(0, 2000))]
        texts[n] = " ".join(own)
    texts |= {1000 + n: " ".join(vocabulary[i] for i in rng.integers(0, 2000, int(rng.integers(1, 90)))) for n in range(60)}
    texts |= {2000: texts[1003].upper(), 2001: texts[1003] + "\n", 2002: "", 2003: None, 2004: "a b", 2005: "A  b"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size, percent, few=few).collect()}
    assert got == linked(texts, size, percent)
    out = minhash.near_duplicates(odd, size, percent).collect()
    assert len(out) == len(ODD) and all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert {(r.component_id, r.kept) for r in out if r.doc_id in (6, 9)} == {(6, True), (6, False)}
    assert minhash.near_duplicates(none, size, percent).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    one, two, three = (" ".join(f"{c}{i}" for i in rng.integers(0, 900, 80)) for c in "abc")
    rows = [(9, one), (9, two), (9, one), (4, one), (5, two), (6, three), (6, three), (9, ""), (7, None)]
    out = [sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()) for n in (1, 5)]
    assert out[0] == out[1]
    top = {(d, n > 0): c for d, n, c, _ in out[0]}
    assert top[9, True] in (4, 5) and top[9, False] == 9 and top[4, True] == 4 and top[5, True] == 5 and top[6, True] == 6 and top[7, False] == 7
    assert all(k == (d == c) for d, _, c, k in out[0]) and len(out[0]) == len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def blocks_by_hand(texts, least):
    """Lines in runs of at least `least` words that lie together in the first document that has a run of them."""
    out, first = {}, {}
    lines = {i: [(n, x.strip()) for n, x in enumerate((t or "").encode().split(b"\n")) if x.strip()] for i, t in texts.items()}
    for i in sorted(lines):
        own, size = [x for _, x in lines[i]], [len(x.split()) for _, x in lines[i]]
        runs = [tuple(own[a : b + 1]) for a in range(len(own)) for b in range(a, len(own)) if sum(size[a : b + 1]) >= least > sum(size[a:b])]
        gone = set()
        for z in {first[r] for r in runs if r in first}:
            there = [x for _, x in lines[z]]
            for a in range(len(own)):
                for x in range(len(there)):
                    n = 0
                    while a + n < len(own) and x + n < len(there) and own[a + n] == there[x + n]:
                        n += 1
                    if sum(size[a : a + n]) >= least:
                        gone |= set(range(a, a + n))
        for r in runs:
            first.setdefault(r, i)
        numbers = {lines[i][g][0] for g in gone}
        out[i] = (texts[i] if not gone else "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in numbers), len(gone))
    return out


def test_line_dedup(spark, odd, none, real):
    texts = {r.doc_id: r.text for r in real.collect()}
    shared = [f"line {k} " + " ".join(f"s{k}x{i}" for i in range(14)) for k in range(9)]
    texts |= {10**6 + n: "\n".join([f"own {n}", *shared[n % 3 : n % 3 + 6], f"tail {n}"]) for n in range(40)}
    texts |= {10**6 + 50: "\n".join([*shared[4:8], "between", *shared[0:4]]), 10**6 + 51: "\n".join(shared[:2])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = blocks_by_hand(texts, 50)
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.line_dedup(df.repartition(7)).collect()}
    assert got == want and sum(n > 0 for _, n in want.values()) > 60
    out = line_dedup.line_dedup(odd)
    assert out.count() == len(ODD) and "source" in out.columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[12].text == "other words\n\nend" and by[12].removed_words == 55 and by[11].removed_lines == 0 and by[1].text is None and by[9].text == ""
    assert sorted(r.text or "" for r in out.where("doc_id IS NULL").collect()) == ["", "a null id " + PASSAGE]
    assert line_dedup.line_dedup(none).count() == 0


def test_patience():
    a, b = list("abcxdef"), list("abxcdyef")
    pairs = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and all(p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False)) and len(pairs) == 6
    same = ["x"] * 5000
    assert len(line_dedup.patience(["p", *same], ["q", *same])) == 5000
    assert line_dedup.common_blocks([1, 2, 3, 4], [3, 4, 9, 1, 2], [30, 30, 1, 30, 30], 50) == [0, 1, 3, 4]


def scores_by_hand(texts, order, backoff=0.4):
    counts, total, out = Counter(), 0, []
    grams = lambda w: [tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    for _, t in texts:
        counts.update(grams(words(t)))
        total += len(words(t))
    for i, t in texts:
        w = words(t)
        own, rest, s = Counter(grams(w)), total - len(w), 0.0
        left = lambda g: counts[g] - own[g]  # noqa: B023, E731
        for k in range(len(w)):
            weight = 1.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if left(g) > 0:
                    s += np.log10(weight * left(g) / (rest if n == 1 else left(g[:-1])))
                    break
                weight *= backoff if n > 1 else 1
            else:
                s += np.log10(weight / (rest + 1))
        out.append((i, len(w), round(s / len(w), 9) if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 4])
def test_lm_scores(spark, odd, none, real, order, monkeypatch):
    for df in (odd, real.limit(150)):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        stored = spark.createDataFrame(texts, "doc_id long, text string")
        got = [(r.doc_id, r.n_words, None if r.lm_score is None else round(r.lm_score, 9)) for r in lm_score.lm_scores(stored, order=order, parts=5).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        for x, y in zip(sorted(got, key=key), sorted(scores_by_hand(texts, order), key=key), strict=True):
            assert x[:2] == y[:2] and (x[2] == y[2] or abs(x[2] - y[2]) < 1e-8)
    assert lm_score.lm_scores(none).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 16)).astype(np.float32) + 3 * rng.integers(0, 3, (900, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, v[0].tolist()) for i in range(30)]  # copies: ties go to the smaller id
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (2005, [1.0]), (None, v[1].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame([(i, x, "extra") for i, x in rows], "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in ann.nearest(df, block=300, query_block=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: np.array(x, dtype=np.float32).astype(float) for i, x in rows if i is not None and i < 2000}
    hits = 0
    for q in (i for i in good if i % 20 == 0):
        exact = sorted(((-(good[q] * good[i]).sum(), i) for i in good if i != q))[:20]
        hits += len({i for _, i in exact} & {i for i, _ in got[q]})
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and all(s == (good[q] * good[i]).sum() for i, s in got[q])
    assert hits >= 0.9 * 20 * len(got) and set(got) == {i for i in good if i % 20 == 0}
    assert ann.nearest(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 1, 0.5)]


def test_nearest_leaves_far_cells_out(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.05 * rng.normal(size=(6000, 32))
    v[3000:5000] = 1.5 * v[3000]  # a third are copies
    made = spark.sparkContext.accumulator(0)
    out = ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), block=500, made=made)
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(range(0, 6000, 20)) and all(len(x) == 20 for x in got.values())
    hits = 0
    for q in got:
        s = v @ v[q]
        s[q] = -np.inf
        exact = np.lexsort((np.arange(6000), -np.round(s, 9)))[:20]
        hits += len(set(exact.tolist()) & set(got[q]))
    assert hits >= 0.95 * 20 * len(got) and 0 < made.value < 0.4 * 300 * 4001
    assert got[3040] == list(range(3000, 3020)) and got[3000] == list(range(3001, 3021))


def test_chi_square():
    x = np.array([0.0, 7.344, 15.507])
    assert np.allclose(ann.chi_square(x, 8), [0, 0.5, 0.95], atol=1e-3)


def rendered_by_hand(turns):
    """Every speaker's whole rendering and mask, and the messages behind it."""
    out, by = {}, defaultdict(list)
    for conv, turn, role, text in turns:
        who = ((role or "").strip(" ").lower() or "unknown").replace("<|", "< |")
        by[conv].append(((turn is not None, turn or 0), who, (text or "").replace("<|", "< |")))
    for conv, own in by.items():
        for speaker in {w for _, w, _ in own if w != "system"}:
            text, mask = "", []
            for _, w, said in sorted(own):
                text += "<|assistant|>\n" if w == speaker else "<|system|>\n" if w == "system" else f"<|user:{w}|>\n"
                if w == speaker:
                    mask.append((len(text), len(said) + 8))
                text += said + "<|end|>\n"
            out[conv, speaker] = (len(own), len(mask), text, mask)
    return out


def test_chat(spark):
    names = ["user", "Anna ", "bob <|x", None, "  "]
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>"), (1, 2, "Anna ", "hello"), (1, 3, "user", None), (1, 3, "user", None), (2, 0, "system", "alone"), (None, None, None, "who"), (None, 4, "X", "")]
    turns += [(3, 0, "user", "a"), (3, 300, "user", "b"), (3, 10**12, "other", "c")]  # numbers with gaps
    turns += [(4, i, "system" if i in (0, 90, 400) else "quiet" if i == 2 else names[i % 5], f"t{i} é") for i in range(1000)]  # one speaker is absent for the rest
    turns += [(5, None, names[i % 3], f"{i}") for i in range(400)] + [(6, 7, "Same", "same")] * 300
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, speaker string, PLACE int")
    got = chat.perspectives(df)
    want = rendered_by_hand(turns)
    assert {(r.conv_id, r.speaker): (r.n_messages, r.n_trained, r.text, [(m.start, m.length) for m in r.mask]) for r in chat.dialogues(got).collect()} == want
    anna = [r for r in got.where("conv_id = 1 AND speaker = 'anna'").orderBy("place").collect()]
    assert [(r.place, r.role, r.name, r.train) for r in anna] == [(0, "system", None, False), (1, "user", "user", False), (2, "assistant", None, True), (3, "user", "user", False), (4, "user", "user", False)]
    assert "".join(r.text for r in anna) == "<|system|>\nbe kind<|end|>\n<|user:user|>\nhi < |end|><|end|>\n<|assistant|>\nhello<|end|>\n<|user:user|>\n<|end|>\n<|user:user|>\n<|end|>\n"
    whole = want[1, "anna"][2]
    assert all(whole[r.start : r.start + r.length] == r.text[-r.length :] for r in anna)
    assert chat.perspectives(df.limit(0)).count() == 0


def shared_with_any(texts, least):
    """Numbers of the lines of each document in blocks of `least` words or more that lie together in any earlier one."""
    lines = {i: t.split("\n") for i, t in texts.items()}
    out = {}
    for i, own in lines.items():
        gone = set()
        for there in (lines[z] for z in lines if z < i):
            for a in range(len(own)):
                for x in range(len(there)):
                    n = 0
                    while a + n < len(own) and x + n < len(there) and own[a + n] == there[x + n]:
                        n += 1
                    if sum(len(t.split()) for t in own[a : a + n]) >= least:
                        gone |= set(range(a, a + n))
        out[i] = [t for n, t in enumerate(own) if n not in gone]
    return out


def test_line_dedup_meets_all_earlier(spark):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"p{k}x{i}" for i in range(n)) for k, n in enumerate([52, 10, 30, 25, 20, 49, 60, 15])]
    texts = {1: pool[0], 2: "\n".join(pool[:2]), 3: "\n".join(pool[:2])}
    texts |= {10 + n: "\n".join(pool[(b + i) % 8] for i in range(int(rng.integers(1, 6)))) for n, b in enumerate(rng.integers(0, 8, 30))}
    got = line_dedup.line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = shared_with_any(texts, 50)
    assert {r.doc_id: r.text for r in got} == {i: "\n".join(t) for i, t in want.items()} and want[3] == []


def test_common_blocks_that_alignment_breaks_up():
    assert line_dedup.common_blocks([1, 2, 1, 3], [1, 3], [30, 30], 50) == [0, 1]
    rng = np.random.default_rng(13)
    for _ in range(300):
        a, b = (rng.integers(0, 5, int(rng.integers(1, 9))).tolist() for _ in range(2))
        words = [12, 20, 30, 45, 55]
        want = set()
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                if sum(words[x] for x in b[i:j]) >= 50 and any(a[k : k + j - i] == b[i:j] for k in range(len(a))):
                    want |= set(range(i, j))
        assert line_dedup.common_blocks(a, b, [words[x] for x in b], 50) == sorted(want)


CLASHING = ["N_BYTES", "_t", "N_Words", "Removed_Words", "Score", "Rule", "KEPT", "Base_Failed", "_v", "_w", "_d", "_dl", "_lines", "_gone", "_s", "_x", "_c0", "_C1", "_score", "_bytes", "TEXT", "Component_ID", "Held_Out"]


@pytest.mark.parametrize(
    ("operator", "new"),
    [
        (lambda df, labels: token_count.token_counts(df), ["n_bytes", "n_tokens", "over_limit"]),
        (lambda df, labels: quality_rules.quality_rules(df, labels), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]),
        (lambda df, labels: quality_classifier.quality_scores(df, labels), ["held_out", "score", "predicted"]),
        (lambda df, labels: line_dedup.line_dedup(df), ["n_lines", "removed_lines", "removed_words"]),
    ],
    ids=["op4", "op2", "op5", "op1"],
)
def test_clashing_names(spark, labels, operator, new):
    """Columns of the result's names are replaced in any case, all others pass, whatever the operator calls its own."""
    df = spark.createDataFrame([(*(f"{c} {i}" for c in CLASHING), i, f"{PASSAGE} {i}\n{PASSAGE}" if i else None) for i in range(4)], ", ".join(f"`{c}` string" for c in CLASHING) + ", doc_id long, text string")
    out = operator(df, labels)
    others = [c for c in CLASHING if c.lower() not in new]
    assert out.columns == [*others, "doc_id", "text", *new]
    rows = sorted(out.toDF(*(f"x{i}" for i in range(len(out.columns)))).collect(), key=lambda r: r[len(others)])
    assert [list(r[: len(others)]) for r in rows] == [[f"{c} {i}" for c in others] for i in range(4)]


def test_clashing_names_of_others(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z", "k"), (2, None, "x", "y", "z", "k")], "doc_id long, text string, Doc_ID_2 string, TEXT string, N_Tokens string, KEY string")
    assert sorted((r.doc_id, r.n_words) for r in lm_score.lm_scores(docs).collect()) == [(1, 3), (2, 0)]
    assert sorted((r.doc_id, r.n_shingles) for r in minhash.near_duplicates(docs).collect()) == [(1, 1), (2, 0)]
    assert sorted((r.doc_id, r.n_tokens) for r in bpe.encode_documents(docs).collect()) == [(1, 3), (2, 0)]
    assert sorted((r.doc_id, r.length) for r in packing.pack(docs).collect()) == [(1, 4), (2, 1)]
