"""Which words set a language's sources apart, and how far the sources are from each other, in exact integers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, cut, stored

#: Terms are runs of ASCII letters and of bytes from 0x80 on; only A-Z have a lower case. All other bytes end a term.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
GROUP = ["lang", "source"]
SCALE = 1_000_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def term_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(lang, source, term, n, d): how often each group has a term, and in how many of its documents.

    A task sums what it reads and sends a row for each distinct term of a group, at the latest when it holds `most`.
    """
    shape = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def told(seen: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in seen.items():
            words = list(n)
            for i in range(0, len(words), 50_000):
                w = words[i : i + 50_000]
                columns = [pa.array([x] * len(w)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(w, pa.binary()).cast(pa.string()), pa.array(map(n.__getitem__, w), pa.int64()), pa.array(map(d.__getitem__, w), pa.int64())], schema=shape)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source")), b.column("text").cast(pa.binary()), strict=True):
                n, d = seen.setdefault((lang, source), (Counter(), Counter()))
                words = terms_of(text.as_py())
                n.update(words)
                d.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > most:
                yield from told(seen)
                seen = {}
        yield from told(seen)

    parts = docs.mapInArrow(counted, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); null without terms. Decimals, as the product may not fit a long."""
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    below = (total + terms).cast("decimal(19,0)")
    return F.when(below > 0, 1 + F.call_function("div", top, below).cast("long"))


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / q)"""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def _joined(rows: DataFrame, groups: DataFrame, on: list[str], most: int = 200_000) -> DataFrame:
    """rows with what is known of their group; groups are broadcast if counted at most `most`."""
    return rows.join(F.broadcast(groups) if groups.count() <= most else groups, on)


def _reached(histogram: DataFrame, digit: str, down: bool) -> DataFrame:
    """Of each group's bins (digit, c), the one in which the need-th row lies, counted from the largest digit or the smallest;
    need: what is still to take in it, left: how many rows it has. A group with fewer rows than it needs gives none."""
    order = F.col(digit).desc() if down else F.col(digit)
    upto = F.sum("c").over(Window.partitionBy(*GROUP).orderBy(order))
    bins = histogram.withColumn("_upto", upto)
    return bins.where("_upto >= need AND _upto - c < need").select(*GROUP, digit, *(c for c in histogram.columns if c not in (*GROUP, digit, "c", "need")), F.expr("need - (_upto - c)").alias("need"), F.col("c").alias("left"))


def _bits(value: str) -> Column:
    return F.when(F.col(value) > 0, F.length(F.bin(value))).otherwise(0)


def largest(rows: DataFrame, k: int, step: int = 12) -> DataFrame:
    """The k rows of each group (lang, source) with the largest value, ties to the smaller item by UTF-8 bytes; value is a
    long from 0 on, and a group's items differ. Groups of k rows or fewer stay whole.

    Radix selection: a histogram of the values' bit lengths tells in which one a group's k-th value lies, then histograms
    of `step` more bits at a time narrow it to one value or to a bin that is taken whole. Rows of that value that
    are too many are told apart by their items' bytes: each pass skips what all of them begin with, then
    counts by the next two bytes. Tasks sum the bins before they shuffle them, and a bin is a row, so no task gets a group's
    rows: at most 64, 2^step or 2^16 + 257 bins.
    """
    count = F.count("*").alias("c")
    first = rows.groupBy(*GROUP, _bits("value").alias("b")).agg(count)
    at = _reached(first.withColumn("need", F.lit(k).cast("long")), "b", down=True)
    at = cut(at.select(*GROUP, F.expr("CASE WHEN b > 0 THEN shiftleft(1L, b - 1) ELSE 0L END").alias("lo"), F.expr("greatest(b - 1, 0)").alias("bits"), "need", "left", F.lit(None).cast("binary").alias("upto"), F.lit(False).alias("ended")))
    near = _joined(rows, at.select(*GROUP, "lo"), GROUP) if at.count() else None
    if near is None:
        return rows
    few = rows.join(F.broadcast(at.select(*GROUP)), GROUP, "left_anti") if at.count() <= 200_000 else rows.join(at.select(*GROUP), GROUP, "left_anti")
    near = stored(near.where("value >= lo").drop("lo").unionByName(few))
    while True:
        open_ = at.where("left > need AND bits > 0")
        if not open_.limit(1).count():
            break
        inside = _joined(near, open_.drop("left", "upto", "ended"), GROUP).where("value >= lo AND value - lo < shiftleft(1L, bits)")
        inside = inside.withColumn("digit", F.expr(f"shiftright(value - lo, greatest(bits - {step}, 0))"))
        found = _reached(inside.groupBy(*GROUP, "lo", "bits", "need", "digit").agg(count), "digit", down=True)
        found = found.select(*GROUP, F.expr(f"lo + shiftleft(digit, greatest(bits - {step}, 0))").alias("lo"), F.expr(f"greatest(bits - {step}, 0)").alias("bits"), "need", "left", F.lit(None).cast("binary").alias("upto"), F.lit(False).alias("ended"))
        at = cut(at.where("NOT (left > need AND bits > 0)").unionByName(found))
    while True:
        open_ = at.where("left > need")
        if not open_.limit(1).count():
            break
        begins = "(upto IS NULL OR substring(CAST(item AS BINARY), 1, octet_length(upto)) = upto)"
        inside = _joined(near, open_.drop("left", "bits", "ended"), GROUP).where(f"value = lo AND {begins}")
        ends = cut(inside.groupBy(*GROUP, "lo", "need").agg(F.min("item").cast("binary").alias("a"), F.max("item").cast("binary").alias("z")).withColumn("same", _common("a", "z")))
        keyed = _joined(near, ends.withColumn("begin", F.expr("substring(a, 1, same)")).drop("a", "z"), GROUP)
        keyed = keyed.where("value = lo AND substring(CAST(item AS BINARY), 1, same) = begin").withColumn("digit", F.expr("substring(CAST(item AS BINARY), same + 1, 2)"))
        found = _reached(keyed.groupBy(*GROUP, "lo", "begin", "need", "digit").agg(count), "digit", down=False)
        found = found.select(*GROUP, "lo", F.lit(0).alias("bits"), "need", "left", F.concat("begin", "digit").alias("upto"), (F.octet_length("digit") < 2).alias("ended"))
        at = cut(at.where("NOT left > need").unionByName(found))
    kept = near.join(F.broadcast(at) if at.count() <= 200_000 else at, GROUP, "left")
    # a bin of fewer than two bytes holds the item that ends there, no longer one
    among = "substring(CAST(item AS BINARY), 1, IF(ended, octet_length(item), octet_length(upto))) <= upto"
    taken = f"lo IS NULL OR value > lo OR value >= lo AND (upto IS NULL OR {among})"
    return kept.where(taken).select(*rows.columns)


def _common(a: str, z: str) -> Column:
    """How many first bytes two binaries have in common."""
    n = F.least(F.octet_length(a), F.octet_length(z))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(a), i, F.lit(1)) == F.substring(F.col(z), i, F.lit(1)))
    return F.when(n < 1, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)).cast("int")


def source_divergence(docs: DataFrame, in_docs: int = 3, most: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group (lang, source) its distance to each other source of the
    language (part `pair`), and its `most` terms that it has more of than the language (part `term`).

    Needs text, lang and source; others are ignored, whatever they are called. Nulls in these count as ''. A term
    stays if at least in_docs documents of its language have it (repeated rows are documents of their own). Ranks are
    by value, ties by the item's UTF-8 bytes. A group without terms has pairs too; without kept terms in the language their
    value is 0. A language with one source has no pairs. An empty table gives no rows.

    A term that neither group of a pair has adds the same to each such pair, as both shares are their groups' smallest.
    So a pair's value is that baseline times the language's terms, corrected by what each group has alone (from
    the group's counts of counts, as the other's share is one number) and, for terms that both have, by a join on the term.
    """
    df, _ = carried(docs, ["text", *GROUP], keep=[])
    df = df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", *GROUP)))
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(df).withColumns({"lang_n": F.sum("n").over(by_term), "lang_d": F.sum("d").over(by_term), "one": F.min("source").over(by_term) == F.col("source")})
    counts = stored(counts.where(F.col("lang_d") >= in_docs).select(*GROUP, "term", "n", "lang_n", "one"))
    langs = counts.groupBy("lang").agg(F.count_if("one").alias("terms"), F.sum("n").alias("lang_total"))
    own = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = df.select(*GROUP).distinct().join(own, GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    groups = cut(groups.withColumn("least", share(F.lit(0), "total", "terms")))
    return _pairs(counts, groups).unionByName(_terms(counts, groups, most))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return rows.select(*GROUP, F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def _terms(counts: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    rows = _joined(counts, groups, GROUP).select(*GROUP, F.col("term").alias("item"), share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    return _ranked(largest(rows.where("p > q").select(*GROUP, "item", gap("p", "q").alias("value")), most), "term")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("least").alias("item_least"))
    pairs = groups.join(other, "lang").where("source <> item").withColumn("base", gap("least", "item_least"))
    pairs = cut(pairs.select(*GROUP, "item", "terms", "least", "item_least", "base"))
    seen = cut(_joined(counts.groupBy(*GROUP, "n").agg(F.count("*").alias("c")), groups.select(*GROUP, "total", "terms"), GROUP).select(*GROUP, share("n", "total", "terms").alias("p"), "c"))
    alone = pairs.join(seen, GROUP).select(*GROUP, "item", (F.col("c") * (gap("p", "item_least") - F.col("base"))).alias("v"))
    theirs = pairs.join(seen.select("lang", F.col("source").alias("item"), "p", "c"), ["lang", "item"]).select(*GROUP, "item", (F.col("c") * (gap("least", "p") - F.col("base"))).alias("v"))
    mine = _joined(counts.select(*GROUP, "term", "n"), groups.select(*GROUP, "total", "terms", "least"), GROUP).select(*GROUP, "term", share("n", "total", "terms").alias("p"), "least")
    a, b = (mine.select("lang", F.col("source").alias(x), "term", F.col("p").alias(f"p{x}"), F.col("least").alias(f"least{x}")) for x in "xy")
    each = lambda x, y: F.sum(gap(f"p{x}", f"p{y}") - gap(f"p{x}", f"least{y}") - gap(f"least{x}", f"p{y}") + gap(f"least{x}", f"least{y}"))
    met = a.join(b, ["lang", "term"]).where("x < y").groupBy("lang", "x", "y").agg(each("x", "y").alias("xy"), each("y", "x").alias("yx"))
    way = lambda g, h, v: F.struct(F.col(g).alias("source"), F.col(h).alias("item"), F.col(v).alias("v"))
    both = met.select("lang", F.inline(F.array(way("x", "y", "xy"), way("y", "x", "yx"))))
    added = alone.unionByName(theirs).unionByName(both).groupBy(*GROUP, "item").agg(F.sum("v").alias("v"))
    value = F.coalesce(F.col("terms") * F.col("base"), F.lit(0)) + F.coalesce("v", F.lit(0))
    return _ranked(pairs.join(added, [*GROUP, "item"], "left").select(*GROUP, "item", value.cast("long").alias("value")), "pair")
