"""A registry of entities that grows as mentions are met: an ordered fold for each namespace and type."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import columns as C
from mnemospark.functions.shared import stored

from .graph import merged
from .vectors import _matrix, _unit

#: Which type a name has that is mentioned as several, and the types whose exact names need no judge.
PRECEDENCE = {"object": 0, "entity": 1, "gpe": 2}
PLAIN = ("gpe", "object")
HIGH, LOW, SPELT = 0.85, 0.75, 0.85

_FOLDED = "namespace string, type string, place long, alias string, how string, id string, fresh string, best string, like double, asks string"


def collected(mentions: DataFrame) -> DataFrame:
    """namespace, place, alias, type, v: each name of a namespace once, whatever its case, at the place of its first mention,
    with the type of the highest precedence and the spelling and vector of the first mention of that type. Names without
    a character go. mentions: namespace, place, alias, type, v; places differ."""
    said = mentions.withColumn("alias", F.trim("alias")).where("alias <> ''")
    rank = F.lit(1)
    for name, n in PRECEDENCE.items():
        rank = F.when(F.col("type") == name, n).otherwise(rank)
    first = F.struct((-rank).alias("r"), F.col("place").alias("p"))
    best = said.groupBy("namespace", F.lower("alias").alias("_k")).agg(F.min("place").alias("place"), F.min_by(F.struct("alias", "type", "v"), first).alias("m"))
    return best.select("namespace", "place", "m.alias", "m.type", "m.v")


class Registry:
    """Entities of one namespace and type: vectors at length 1, ids, aliases, and who is called what."""

    def __init__(self, width: int):
        self.n, self.vectors = 0, np.zeros((16, width))
        self.ids: list[str] = []
        self.there: set[str] = set()
        self.aliases: list[list[str]] = []
        self.called: dict[str, int] = {}

    def add(self, id_: str, aliases: list[str], vector: np.ndarray) -> None:
        if self.n == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.n] = vector
        self.ids.append(id_)
        self.there.add(id_)
        self.aliases.append([])
        self.n += 1
        for a in aliases:
            self.call(self.n - 1, a)

    def call(self, i: int, alias: str) -> None:
        """Of several entities with one alias the last is meant."""
        if alias not in self.aliases[i]:
            self.aliases[i].append(alias)
        self.called[alias.strip().lower()] = i

    def best(self, likes: np.ndarray, but: int | None) -> tuple[int, float] | None:
        """The entity of the highest likeness, ties to the smaller id, another than `but`."""
        if but is not None:
            likes = likes.copy()
            likes[but] = -2.0
        if len(likes) == 0 or likes.max() < -1.5:
            return None
        at = np.flatnonzero(likes == likes.max())
        i = min(at.tolist(), key=self.ids.__getitem__)
        return i, float(likes[i])

    def spelt(self, alias: str, i: int) -> float:
        plain = lambda t: " ".join(t.lower().split())
        return max((SequenceMatcher(None, plain(alias), plain(a)).ratio() for a in self.aliases[i]), default=0.0)


def _folded(rows: DataFrame, width: int, high: float, low: float, spelt: float, conservative: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, Registry(width)
        for b in batches:
            v = _unit(_matrix(b.column("v"))) if b.num_rows else np.zeros((0, width))
            v = v if v.shape[1] == width else np.zeros((len(v), width))
            cols = {c: b.column(c).to_pylist() for c in ("namespace", "type", "kind", "place", "alias", "id", "aliases")}
            keys = list(zip(cols["namespace"], cols["type"], strict=True))
            out: list[tuple] = []
            likes, since, upto = np.zeros((0, 0)), 0, 0
            for i, key in enumerate(keys):
                if key != group:
                    group, state, upto = key, Registry(width), i
                alias, id_ = cols["alias"][i], cols["id"][i]
                if cols["kind"][i] == 0:
                    state.add(id_, cols["aliases"][i], v[i])
                    upto = i + 1
                    continue
                if i >= upto:  # products of the next mentions with what is known by now, in one step
                    more = max(1, min(512, 4_000_000 // max(1, state.n)))
                    upto = next((j for j in range(i, min(len(keys), i + more)) if keys[j] != key), min(len(keys), i + more))
                    likes, since, known = v[i:upto] @ state.vectors[: state.n].T, i, state.n
                like = np.round(np.concatenate([likes[i - since], state.vectors[known : state.n] @ v[i]]), 6)
                exact = state.called.get(alias.strip().lower())
                found = state.best(like, exact)
                asks = found is not None and (found[1] >= high or found[1] >= low and state.spelt(alias, found[0]) >= spelt)
                sure = found is not None and not conservative and found[1] >= high
                best, near = (state.ids[found[0]], found[1]) if found else (None, None)
                if exact is not None:
                    judged = conservative and key[1] not in PLAIN
                    out.append((*key, cols["place"][i], alias, "ask" if judged else "exact", state.ids[exact], id_, best, near, "same" if sure else "ask" if asks else None))
                elif sure:
                    state.call(found[0], alias)
                    out.append((*key, cols["place"][i], alias, "alike", best, id_, best, near, None))
                elif asks:
                    out.append((*key, cols["place"][i], alias, "ask", None, id_, best, near, "ask"))
                else:
                    if id_ not in state.there:
                        state.add(id_, [alias], v[i])
                    out.append((*key, cols["place"][i], alias, "new", id_, id_, best, near, None))
            names = [p.split()[0] for p in _FOLDED.split(", ")]
            kinds = [pa.int64() if n == "place" else pa.float64() if n == "like" else pa.string() for n in names]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, _FOLDED)


def grown(mentions: DataFrame, registry: DataFrame, high: float = HIGH, low: float = LOW, spelt: float = SPELT, conservative: bool = True, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Whom mentions (as `collected` gives them) mean, in order of place, against a registry (namespace, id, type, place,
    aliases, v) that grows: (namespace, alias, type, id, how), and what a judge is asked: (namespace, alias, type, kind, id, like).

    A mention whose name an entity of its type has is that one (exact; a judge is asked where `conservative`, but for
    places and objects). Else the most alike entity known by then counts, whoever was new before it included: from `high`
    on, or from `low` on if it is also spelt like one of its aliases, they may be one. A judge is asked (ask), or, if not
    conservative, from `high` on they are one (alike) and the entity gets the alias. Anyone else is new and known from then on.
    Where an exact name has another entity as alike as that, the two may be one as well (kind merge).

    verdicts (namespace, alias, type, kind, same): what a judge said; kinds are exact, alias and merge. Without one, or if
    it says no, an alias is an entity of its own, an exact name means nobody (id null), and nothing merges. Entities
    that are one get the smallest id of theirs, transitively.

    The rows of a namespace and type stream through one task in order, which holds that registry alone. Ties for the most
    alike go to the smaller id. Vectors have one length; null and zero ones are like nobody.
    """
    own = C.stable_id("entity", F.col("namespace"), F.col("type"), C.collapsed(F.col("alias")))
    known = registry.select("namespace", "type", F.lit(0).alias("kind"), "place", F.lit(None).cast("string").alias("alias"), F.col("id").cast("string").alias("id"), "aliases", F.col("v").cast("array<double>").alias("v"))
    said = mentions.select("namespace", "type", F.lit(1).alias("kind"), "place", "alias", own.alias("id"), F.lit(None).cast("array<string>").alias("aliases"), F.col("v").cast("array<double>").alias("v"))
    sized = said.select(F.max(F.size("v")).alias("n")).unionByName(known.select(F.max(F.size("v")).alias("n"))).agg(F.max("n").alias("n")).first()
    rows = known.unionByName(said).repartition("namespace", "type").sortWithinPartitions("namespace", "type", "kind", "place", "alias", "id")
    fold = stored(_folded(rows, max(1, sized.n or 1), high, low, spelt, conservative))
    kind = lambda name: F.lit(name).alias("kind")
    asked = fold.where("how = 'ask'").select("namespace", "alias", "type", F.when(F.col("id").isNull(), "alias").otherwise("exact").alias("kind"), F.coalesce("id", "best").alias("id"), F.when(F.col("id").isNull(), F.col("like")).alias("like"))
    asked = asked.unionByName(fold.where("asks = 'ask' AND id IS NOT NULL AND how IN ('ask', 'exact')").select("namespace", "alias", "type", kind("merge"), F.col("best").alias("id"), "like"))
    if verdicts is None:
        yes = asked.limit(0).select("namespace", "alias", "type", "kind")
    else:
        yes = verdicts.where("same").select("namespace", "alias", "type", "kind").distinct()
    on = ["namespace", "alias", "type"]
    agreed = yes.where("kind <> 'merge'").select(*on, F.lit(True).alias("agreed")).distinct()
    meant = F.when(F.col("how") != "ask", F.col("id")).when(F.col("agreed"), F.coalesce("id", "best")).when(F.col("id").isNull(), F.col("fresh"))
    how = F.when(F.col("how") != "ask", F.col("how")).when(F.col("agreed"), "judged").when(F.col("id").isNull(), "new").otherwise("unresolved")
    out = fold.join(agreed, on, "left").select(*on, meant.alias("id"), how.alias("how"), F.col("id").alias("named"), "best", "asks")
    one = out.where("asks = 'same'").select("named", "best").unionByName(out.where("asks = 'ask' AND named IS NOT NULL").join(yes.where("kind = 'merge'").select(*on), on, "left_semi").select("named", "best"))
    pairs = one.select(F.col("named").alias("a"), F.col("best").alias("b")).distinct()
    out = out.select(*on, "id", "how")
    if pairs.limit(1).count():
        out = out.join(merged(pairs), "id", "left").select(*on, F.coalesce("canonical", "id").alias("id"), "how")
    return out, asked
