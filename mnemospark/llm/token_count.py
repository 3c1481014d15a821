"""Token counts of whole texts: a broadcast table of frequent pre-token lengths, and worker caches for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, tokenizer_path

#: A pre-token after the prefix space: spaces, then what lies before the next space; spaces alone at the end.
_PRE = re.compile(" *[^ ]+| +")
#: Longer pre-tokens are encoded each time, so that a cache entry is small.
LONGEST = 256


def pre_tokens(text: str) -> list[str]:
    """The parts of a text that the pieces never cross, each without the one space before it.

    The model writes a space as U+2581 and puts one before the text; none of its pieces has that mark after another
    character, so merges stay within these parts and their lengths add up.
    """
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [p[1:] for p in _PRE.findall(" " + text)]
    return text.split(" ")


class Lengths:
    """Lengths of pre-tokens: the frequent ones given, others encoded once and kept until there are `most`."""

    def __init__(self, model: str, frequent: dict[str, int], most: int = 300_000):
        self.model, self.frequent, self.most = model, frequent, most
        self.known, self.encoder = dict(frequent), None

    def encoded(self, parts: list[str]) -> list[int]:
        if self.encoder is None:
            import sentencepiece

            self.encoder = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(self.model))
        return [len(ids) if part else 1 for part, ids in zip(parts, self.encoder.encode(parts, num_threads=1), strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts = pre_tokens(text)
            known = self.known
            try:
                out.append(sum(map(known.__getitem__, parts)))
                continue
            except KeyError:
                new = [p for p in dict.fromkeys(parts) if p not in known]
            if len(known) + len(new) > self.most + len(self.frequent):
                self.known = known = dict(self.frequent)
                new = [p for p in dict.fromkeys(parts) if p not in known]
            found = dict(zip(new, self.encoded(new), strict=True))
            known.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
            out.append(sum(known[p] if p in known else found[p] for p in parts))
        return out


def frequent_lengths(docs: DataFrame, model: str, frequent: int, sample_docs: int, sample_parts: int = 16) -> dict[str, int]:
    """The commonest pre-tokens of at most sample_docs documents, with their lengths: at most `frequent` entries.

    The documents are the first of up to sample_parts partitions, spread evenly, so no more is read at any size, and
    each task sends counts of at most `frequent` pre-tokens, no texts. The table only saves encoding; which documents
    it saw changes no result.
    """
    rows = docs.select("text").rdd
    there = rows.getNumPartitions()
    some = sorted({i * there // sample_parts for i in range(sample_parts)}) if there else []
    each = -(-sample_docs // max(1, len(some)))

    def commonest(texts: Iterator) -> list[tuple[str, int]]:
        seen: Counter = Counter()
        for row in islice(texts, each):
            seen.update(p for p in pre_tokens(row[0] or "") if len(p) <= LONGEST)
        return seen.most_common(frequent)

    total: Counter = Counter()
    for p, n in docs.sparkSession.sparkContext.runJob(rows, commonest, some) if some else []:
        total[p] += n
    top = [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:frequent]]
    return dict(zip(top, Lengths(model, {}).encoded(top), strict=True)) if top else {}


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, keep: list[str] | None = None, frequent: int = 30_000, sample_docs: int = 2_048) -> DataFrame:
    """docs (its columns `keep`, all by default) with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    Needs a column text; a null text counts as empty, with 0 bytes and tokens. Columns of the result's names, in any
    case, are replaced; others pass. Every row is counted by itself, so repeated rows count alike; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    df, back = carried(docs, ["text"], ["n_bytes", "n_tokens", "over_limit"], keep)
    shared = spark.sparkContext.broadcast(frequent_lengths(df, model, frequent, sample_docs))
    whole = "text" in {c.lower() for c in (docs.columns if keep is None else keep)}
    own = [c for c in df.columns if c != "text" or whole]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(model, shared.value)
        for b in batches:
            n = lengths.count([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), b.column("_bytes"), pa.array(n, pa.int64())], names=[*own, "_bytes", "_tokens"])

    df = df.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    schema = df.select(*own, "_bytes").withColumn("_tokens", F.lit(0).cast("long")).schema
    return df.mapInArrow(counted, schema).select(*back, F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_tokens") > limit).alias("over_limit"))
