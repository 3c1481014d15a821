"""Benchmark people in full: what drives them, when they tell what, lives in seven attributes, conditional points, questions, long contexts.

Chance comes from hashes of ids alone (functions.columns.hash_unit), so rows are the same however they are dealt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.columns import hash_unit
from mnemospark.functions.lazy import pd
from mnemospark.functions.shared import dealt, stored

from .windows import running

#: Attributes that change, how readily each does, and what of a person moves that.
OFTEN, SELDOM = ("Health_Status", "Social_Status", "Work_Status"), ("Residence", "Marital_Status", "Children_Status", "Career_Status")
READINESS = {"Health_Status": 1.0, "Social_Status": 1.0, "Work_Status": 1.0, "Residence": 1.3, "Marital_Status": 1.6, "Children_Status": 1.8, "Career_Status": 1.3}
GOALS = (
    (("career", "achievement", "success"), {"Career_Status": 1.6, "Work_Status": 1.2}),
    (("family", "relationship", "marriage"), {"Marital_Status": 2.0, "Children_Status": 1.8}),
    (("health", "wellness", "fitness"), {"Health_Status": 1.8}),
    (("travel", "explore", "move", "settle"), {"Residence": 1.6}),
    (("social", "friend", "community"), {"Social_Status": 1.6}),
)
TEMPERS = (
    ("e", None, ("social", "outgoing"), {"Social_Status": 1.2}),
    (None, "j", ("ambitious", "organized"), {"Career_Status": 1.1, "Work_Status": 1.1}),
    (None, None, ("sensitive", "stress"), {"Health_Status": 1.1}),
)
GROUP_SHARE, ONE_CHANGE = {"often": 0.60, "seldom": 0.40}, 0.65
#: How a seldom attribute gains weight: for each change it must make beyond one, by its name, for the married, and for each session without.
CHANGE_BONUS, NAME_BONUS, MARRIED_BONUS, WAIT_BONUS, MOST_WAIT_BONUS = 0.20, {"Marital_Status": 1.35, "Children_Status": 1.80}, 1.50, 0.08, 0.8
LEAST_CHANGES = {"Residence": 3, "Career_Status": 3, "Marital_Status": 3, "Children_Status": 2}
#: This engine's own values, where no file tells others (`read_space`): what attributes may be, and how many sessions one rests after a change.
STATES = {
    "Work_Status": ("Calm", "Busy", "Overloaded"), "Social_Status": ("Quiet", "Active", "Withdrawn"), "Physical_Health": ("Good", "Tired", "Injured"), "Mental_Health": ("Stable", "Anxious", "Low"),
    "Career_Status": ("Employed|Agency|Analyst", "Employed|School|Teacher", "Entrepreneur|Startup|Founder", "Unemployed||"),
}
MARITAL = {"Single": ("Dating",), "Dating": ("Married", "Single"), "Married": ("Divorced",), "Divorced": ("Dating",)}
CITIES = {"Australia": ("Darwin", "Perth", "Hobart"), "Norway": ("Bergen", "Oslo"), "Ghana": ("Accra", "Kumasi", "Tamale")}
REST = {"Health_Status": 1, "Social_Status": 1, "Work_Status": 1, "Residence": 3, "Marital_Status": 4, "Children_Status": 9, "Career_Status": 4}
MOST_CHILDREN, LEAST_AGE = 4, 20


@dataclass
class Space:
    """What attributes may be and become: states of each, marital moves, cities by country, sessions an attribute rests, how many
    children there may be and from what age on, and how a life begins."""

    states: dict[str, list[str]] = field(default_factory=lambda: {a: list(s) for a, s in STATES.items()})
    marital: dict[str, list[str]] = field(default_factory=lambda: {a: list(s) for a, s in MARITAL.items()})
    cities: dict[str, list[str]] = field(default_factory=lambda: {a: list(s) for a, s in CITIES.items()})
    rest: dict[str, int] = field(default_factory=lambda: dict(REST))
    most_children: int = MOST_CHILDREN
    least_age: int = LEAST_AGE
    begins: dict[str, str] = field(default_factory=dict)

    def broken(self) -> list[str]:
        """What can't be lived in: moves to states that there aren't, attributes without two states, no way out of a state, no second city."""
        out = [f"{a} has fewer than two states" for a, s in self.states.items() if len(set(s)) < 2]
        out += [f"{a} has no states" for a in ("Work_Status", "Social_Status", "Physical_Health", "Mental_Health", "Career_Status") if a not in self.states]
        out += [f"no move from {a}" for a, to in self.marital.items() if not to]
        out += [f"{a} leads to {t}, which leads nowhere" for a, to in self.marital.items() for t in to if t not in self.marital]
        out += [f"{a} begins with {v}, which it can't be" for a, v in self.begins.items() if a in self.states and v not in self.states[a] or a == "Marital_Status" and v not in self.marital]
        if sum(len(set(c)) for c in self.cities.values()) < 2:
            out.append("fewer than two cities")
        return out

    def first(self) -> dict[str, str | int]:
        country = next(iter(self.cities))
        own = {a: s[0] for a, s in self.states.items()} | {"Residence": f"{self.cities[country][0]}, {country}", "Marital_Status": next(iter(self.marital)), "Children_Status": 0}
        return own | self.begins


def read_space(spark: SparkSession, path: str) -> Space:
    """The state space of a JSON file with some of Space's fields; others are this engine's own. Files are small: one is read
    whole, through Spark's readers, and an error tells all that is wrong with it."""
    text = spark.read.text(path, wholetext=True).first()
    space = Space(**json.loads(text["value"] if text else "{}"))
    if wrong := space.broken():
        raise ValueError("; ".join(wrong))
    return space


REVEALED = ("Residence", "Marital_Status", "Children_Status", "Career_Status", "Work_Status", "Health_Status", "Social_Relationships")


def drivers(mbti: Column, tags: Column, goal: Column) -> Column:
    """Struct of how readily each attribute changes, by a person's goal (text), MBTI type and tags (array)."""
    goal, kind, words = F.lower(F.coalesce(goal, F.lit(""))), F.lower(F.coalesce(mbti, F.lit(""))), F.lower(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    has = lambda text, some: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in some))
    weights = {a: F.lit(w) for a, w in READINESS.items()}
    for some, factors in GOALS:
        for a, x in factors.items():
            weights[a] = weights[a] * F.when(has(goal, some), x).otherwise(1.0)
    for first, last, some, factors in TEMPERS:
        test = has(words, some)
        test = test | (F.left(kind, F.lit(1)) == first) if first else test
        test = test | (F.right(kind, F.lit(1)) == last) if last else test
        for a, x in factors.items():
            weights[a] = weights[a] * F.when(test, x).otherwise(1.0)
    return F.struct(*(w.alias(a) for a, w in weights.items()))


def reveals(people: DataFrame) -> DataFrame:
    """persona, date, place and attribute: on three to six days of January 2022, in order, a person tells its first state; each
    day tells something, and the seven attributes are dealt by chance."""
    count = (3 + F.floor(hash_unit(F.col("persona"), F.lit("reveals")) * 4)).cast("int")
    at = people.select("persona", count.alias("n"))
    days = at.select("persona", "n", F.explode(F.sequence(F.lit(1), F.lit(31))).alias("day"))
    drawn = days.withColumn("r", F.row_number().over(Window.partitionBy("persona").orderBy(hash_unit(F.col("persona"), F.lit("day"), F.col("day"))))).where("r <= n")
    dates = drawn.select("persona", F.make_date(F.lit(2022), F.lit(1), F.col("day")).alias("date"), (F.row_number().over(Window.partitionBy("persona").orderBy("day")) - 1).alias("place"))
    told = at.select("persona", "n", F.explode(F.array(*map(F.lit, REVEALED))).alias("attribute"))
    told = told.withColumn("r", F.row_number().over(Window.partitionBy("persona").orderBy(hash_unit(F.col("persona"), F.lit("attribute"), F.col("attribute")))) - 1)
    place = F.when(F.col("r") < F.col("n"), F.col("r")).otherwise(F.floor(hash_unit(F.col("persona"), F.lit("group"), F.col("attribute")) * F.col("n")).cast("int"))
    return told.select("persona", place.alias("place"), "attribute").join(dates, ["persona", "place"])


def sampled(seeds: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """n seeds (seed) that are not known yet (seed), by hash, each once."""
    return seeds.select("seed").distinct().join(known.select("seed").distinct(), "seed", "left_anti").orderBy(hash_unit(F.col("seed"), F.lit("sample")), "seed").limit(n)


def _chosen(u: float, weights: dict[str, float]) -> str:
    """What a draw from 0 to 1 falls on, each thing being as wide as its weight."""
    left = u * sum(weights.values())
    for name, w in weights.items():
        left -= w
        if left < 0:
            return name
    return name


class Life:
    """A person's seven attributes from session to session."""

    def __init__(self, born: int, space: Space | None = None):
        self.born, self.last, self.space = born, {}, space or Space()
        self.state = self.space.first()

    def free(self, session: int, year: int) -> list[str]:
        """What may change now: what doesn't rest, and children only to the married, old enough, with fewer than four."""
        may = [a for a in (*OFTEN, *SELDOM) if session - self.last.get(a, -99) > self.space.rest[a]]
        children = self.state["Marital_Status"] == "Married" and self.state["Children_Status"] < self.space.most_children and year - self.born >= self.space.least_age
        return [a for a in may if a != "Children_Status" or children]

    def weights(self, group: tuple[str, ...], session: int, drive: dict[str, float]) -> dict[str, float]:
        """How an attribute of a group weighs: seldom ones more the longer ago they changed and the oftener they must."""
        out = {a: drive[a] for a in group}
        for a in group:
            if a in SELDOM:
                bonus = (1.0 + (LEAST_CHANGES[a] - 1) * CHANGE_BONUS) * NAME_BONUS.get(a, 1.0)
                bonus *= MARRIED_BONUS if a == "Children_Status" and self.state["Marital_Status"] == "Married" else 1.0
                out[a] *= (1.0 + min((session - self.last.get(a, -3)) * WAIT_BONUS, MOST_WAIT_BONUS)) * bonus
        return out

    def changed(self, attribute: str, u: float, session: int) -> tuple[str, str, str]:
        """(field, before, after) of one change by the draw u."""
        pick = lambda some: some[int(u * len(some)) % len(some)]
        field = attribute
        if attribute == "Health_Status":
            field = "Physical_Health" if u < 0.5 else "Mental_Health"
            u = u * 2 % 1
        before = self.state[field]
        if attribute == "Children_Status":
            after = before + 1
        elif attribute == "Marital_Status":
            after = pick(self.space.marital[before])
        elif attribute == "Residence":
            city, country = before.split(", ")
            cities = self.space.cities
            own = [f"{c}, {country}" for c in cities.get(country, ()) if c != city]
            others = [f"{c}, {k}" for k in cities if k != country for c in cities[k]]
            near, u = u < 0.5, u * 2 % 1
            after = pick((own or others) if near else (others or own))
        else:
            after = pick([s for s in self.space.states[field] if s != before])
        self.state[field], self.last[attribute] = after, session
        return field, str(before), str(after)


LIVES = "persona long, session int, attribute string, field string, before string, after string"


def lives(sessions: DataFrame, space: Space | None = None) -> DataFrame:
    """persona, session, attribute, field, before and after of every change in people's lives.

    sessions: persona, session (from 0), date, born (a year) and drive (a struct of drivers). A session changes one
    attribute (65 %) or two: first those that change often (60 %) or seldom, by what drives the person, then one of them.
    What attributes may be and become is told by `space`, a small table that goes to all tasks.
    A person's sessions stream by in order, so a life of any length needs the same memory.
    """
    shared = sessions.sparkSession.sparkContext.broadcast(space or Space())
    drives = sessions.schema["drive"].dataType.names
    # rows are dealt and sorted while they are narrow, over all partitions: small rows must not end in a few long tasks; draws come after that
    narrow = sessions.select("persona", "session", F.year("date").alias("year"), "born", *(F.col("drive")[a].alias(f"d{i}") for i, a in enumerate(drives)))
    order = dealt(narrow, "persona").sortWithinPartitions("persona", "session")
    unit = lambda name: hash_unit(F.col("persona"), F.col("session"), F.lit(name))
    names = {"g": "group", "a": "attribute", "v": "value"}
    drawn = order.withColumn("two", unit("two")).withColumns({f"{x}0": unit(f"{n}0") for x, n in names.items()} | {f"{x}1": F.when(F.col("two") >= ONE_CHANGE, unit(f"{n}1")) for x, n in names.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, life = None, Life(0, shared.value)
        for b in batches:
            out = []
            columns = (b[c].to_list() for c in ("persona", "session", "year", "born", "two", "g0", "a0", "v0", "g1", "a1", "v1", *(f"d{i}" for i in range(len(drives)))))
            for persona, session, year, born, two, g0, a0, v0, g1, a1, v1, *drive_of in zip(*columns, strict=True):
                if persona != at:
                    at, life, drive = persona, Life(born, shared.value), dict(zip(drives, drive_of, strict=True))
                left = life.free(session, year)
                for g, a, v in ((g0, a0, v0),) if two < ONE_CHANGE else ((g0, a0, v0), (g1, a1, v1)):
                    groups = {"often": tuple(x for x in left if x in OFTEN), "seldom": tuple(x for x in left if x in SELDOM)}
                    share = {n: GROUP_SHARE[n] * sum(drive[x] for x in own) / len(own) for n, own in groups.items() if own}
                    if not share:
                        break
                    attribute = _chosen(a, life.weights(groups[_chosen(g, share)], session, drive))
                    left.remove(attribute)
                    out.append((at, session, attribute, *life.changed(attribute, v, session)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LIVES.split(", ")])

    return drawn.mapInPandas(run, LIVES)


#: When plans are made, and for what.
PLANNED_AT, PLANNED_FOR = "2026-01-15", "planning_only"


def timeline(sessions: DataFrame, changes: DataFrame, begins: dict[str, str]) -> DataFrame:
    """persona, session, date, kind, before, after and updated: every session with the whole state before and after it (maps),
    and the fields that changed, by name; at the end of each persona a session in which nothing changes but plans are made.

    sessions: persona, session, date. changes: persona, session, field, after, several of one field in a session only if they
    are told apart by `place`; the last counts. begins: how each field begins. A session without changes is chitchat. A persona's sessions are
    its own few; windows over them hold one row each.
    """
    place = [F.col("place")] if "place" in changes.columns else [F.lit(0)]
    last = changes.where(F.col("field").isin(*begins)).groupBy("persona", "session", "field").agg(F.max_by("after", F.struct(*place, "after")).alias("after"))
    told = last.groupBy("persona", "session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.col("after").cast("string"))))).alias("new"))
    at = sessions.select("persona", "session", F.col("date").cast("date").alias("date")).join(told, ["persona", "session"], "left")
    order = Window.partitionBy("persona").orderBy("session")
    for i, (name, value) in enumerate(begins.items()):
        new = F.try_element_at("new", F.lit(name))
        at = at.withColumn(f"_a{i}", F.coalesce(F.last(new, ignorenulls=True).over(order), F.lit(str(value))))
        at = at.withColumn(f"_b{i}", F.coalesce(F.lag(f"_a{i}").over(order), F.lit(str(value))))
    state = lambda x: F.create_map(*(c for i, n in enumerate(begins) for c in (F.lit(n), F.col(f"_{x}{i}"))))
    changed = F.array_compact(F.array(*(F.when(F.col(f"_a{i}") != F.col(f"_b{i}"), F.lit(n)) for i, n in enumerate(begins))))
    rows = at.select("persona", "session", "date", F.when(F.size(changed) > 0, "update").otherwise("chitchat").alias("kind"), state("b").alias("before"), state("a").alias("after"), changed.alias("updated"))
    ends = rows.groupBy("persona").agg(F.max_by("after", "session").alias("after"), (F.max("session") + 1).alias("session"))
    plans = ends.select("persona", "session", F.lit(PLANNED_AT).cast("date").alias("date"), F.lit("future_plan").alias("kind"), F.col("after").alias("before"), "after", F.array().cast("array<string>").alias("updated"))
    return rows.unionByName(plans)


def conditional_points(groups: DataFrame, gap: int = 5, first: int = 9, most_rules: int = 4) -> DataFrame:
    """persona, conflict, role and session: where a preference's rules are told, at least `gap` sessions apart if there is room.

    groups: persona, conflict, rules (how many, up to most_rules) and sessions (the persona's number of sessions, the last
    of which tells nothing). Point_A lies in sessions 0 to `first`; each later point after the one before it; where nothing
    is left after it, the rest is not told.
    """
    last = F.col("sessions") - 2
    u = lambda name: hash_unit(F.col("persona"), F.col("conflict"), F.lit(name))
    at = groups.withColumn("_s0", F.when(last >= 0, F.floor(u("A") * (F.least(F.lit(first), last) + 1)).cast("int")))
    for i in range(1, most_rules):
        before = F.col(f"_s{i - 1}")
        low = F.when(before + gap <= last, before + gap).otherwise(before + 1)
        at = at.withColumn(f"_s{i}", F.when((F.col("rules") > i) & (low <= last), (low + F.floor(u("ABCDEFGH"[i]) * (last - low + 1))).cast("int")))
    points = F.array(*(F.struct(F.lit(f"Point_{'ABCDEFGH'[i]}").alias("role"), F.col(f"_s{i}").alias("session")) for i in range(most_rules)))
    return at.select("persona", "conflict", F.inline(points)).where("session IS NOT NULL")


def between(points: DataFrame, chitchat: DataFrame) -> DataFrame:
    """persona, conflict and session of a distractor between a conflict's first and last point: in a session of small talk
    (chitchat: persona, session) if there is one, else in any; by hash."""
    ends = points.groupBy("persona", "conflict").agg(F.min("session").cast("long").alias("first"), F.max("session").cast("long").alias("last")).where("last > first + 1")
    talk = chitchat.groupBy("persona").agg(F.collect_set(F.col("session").cast("long")).alias("talk"))  # a persona's sessions are its own few
    drawn = lambda some: F.array_min(F.transform(some, lambda s: F.struct(hash_unit(F.col("persona"), F.col("conflict"), s).alias("u"), s.alias("session"))))["session"]
    spoken = F.filter("talk", lambda s: (s > F.col("first")) & (s < F.col("last")))
    # the sessions between are looked at where the conflict's row is: none of them is a row that is shuffled
    session = F.coalesce(drawn(spoken), drawn(F.sequence(F.col("first") + 1, F.col("last") - 1)))
    return ends.join(talk, "persona", "left").select("persona", "conflict", session.cast(points.schema["session"].dataType).alias("session"))


def field_name(path: Column) -> Column:
    """How a field is called in a question: the last part of its path, in words."""
    return F.lower(F.translate(F.element_at(F.split(path, r"\."), -1), "_", " "))


def dynamic_questions(changes: DataFrame) -> DataFrame:
    """Two questions for each change (persona, session, field, before, after): whether it changed and how; numbered within a session."""
    name = field_name(F.col("field"))
    asked = F.array(
        F.struct(F.concat(F.lit("Has the user's "), name, F.lit(" changed recently?")).alias("question"), F.lit("Yes.").alias("answer"), F.lit("easy").alias("difficulty"), F.lit(0).alias("part")),
        F.struct(F.concat(F.lit("How has the user's "), name, F.lit(" changed?")).alias("question"), F.concat(F.lit("The user's "), name, F.lit(" changed from "), F.col("before"), F.lit(" to "), F.col("after"), F.lit(".")).alias("answer"), F.lit("medium").alias("difficulty"), F.lit(1).alias("part")),
    )
    flat = changes.select("persona", "session", "field", F.inline(asked))
    place = F.row_number().over(Window.partitionBy("persona", "session").orderBy("field", "part"))
    return flat.select("persona", "session", F.format_string("Q_%03d", place).alias("question_id"), "question", "answer", F.lit("dynamic_conflict").alias("conflict_type"), "difficulty")


#: How far a static fact is told again, and among which sessions first.
STATIC_GAP, STATIC_FIRST = 10, (0, 9)
STATED_AT = "persona long, conflict long, role string, session int, rung int"


def static_points(conflicts: DataFrame, sessions: DataFrame, gap: int = STATIC_GAP, first: tuple[int, int] = STATIC_FIRST) -> DataFrame:
    """persona, conflict, role (Point_A, Point_B, Distractor), session and rung: where each conflict of a static fact is told.

    conflicts: persona, conflict, distractor (whether there is one). sessions: persona, session (from 0, without holes), kind.
    A persona's conflicts go in order of a hash. Point_A takes turns among the sessions `first` from and to, shuffled; the last session
    holds nothing. Point_B lies after it, on the first rung that has room: 0 a chitchat at least `gap` later that holds nothing yet; 1 any
    such session; 2 any later one that holds nothing; 3 any later one. Distractors lie between both, where nothing is yet (0), else
    anywhere there (1). Who finds no place is left out. Draws are by hash.

    A persona's sessions and conflicts stream by in order; a task holds one persona's sessions, the ones taken and no more.
    """
    unit = lambda *parts: hash_unit(F.col("persona"), *parts)
    told = conflicts.select("persona", F.lit(1).alias("what"), F.col("conflict").cast("long").alias("n"), F.lit(None).cast("string").alias("kind"), F.coalesce("distractor", F.lit(False)).alias("distractor"), unit(F.col("conflict"), F.lit("order")).alias("key"), unit(F.col("conflict"), F.lit("B")).alias("b"), unit(F.col("conflict"), F.lit("D")).alias("d"))
    held = sessions.select("persona", F.lit(0).alias("what"), F.col("session").cast("long").alias("n"), "kind", F.lit(False).alias("distractor"), unit(F.col("session"), F.lit("A")).alias("key"), F.lit(0.0).alias("b"), F.lit(0.0).alias("d"))
    dealt = held.unionByName(told).repartition("persona").sortWithinPartitions("persona", "what", "key", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, place = None, None
        for batch in batches:
            out = []
            for persona, what, n, kind, distractor, b, d in zip(*(batch[c] for c in ("persona", "what", "n", "kind", "distractor", "b", "d")), strict=True):
                if persona != at:
                    at, place = persona, _Places(gap, first)
                if what == 0:
                    place.add(int(n), kind)
                else:
                    out += [(persona, n, *p) for p in place.told(bool(distractor), b, d)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATED_AT.split(", ")])

    return dealt.mapInPandas(run, STATED_AT)


class _Places:
    """The sessions of one persona, as they come in the order of their draw, and which hold something."""

    def __init__(self, gap: int, first: tuple[int, int]):
        self.gap, self.first, self.kinds, self.order, self.taken, self.turn = gap, first, {}, [], set(), 0

    def add(self, session: int, kind: str | None) -> None:
        self.kinds[session] = kind
        self.order.append(session)

    def told(self, distractor: bool, b: float, d: float) -> list[tuple[str, int, int]]:
        last = len(self.kinds) - 1
        starts = [s for s in self.order if self.first[0] <= s <= self.first[1] and s != last]
        if not starts:
            return []
        a = starts[self.turn % len(starts)]
        self.turn += 1
        self.taken.add(a)
        later, free = range(a + 1, last), lambda some: [s for s in some if s not in self.taken]
        far = [s for s in later if s - a >= self.gap]
        at = self._drawn(([s for s in free(far) if self.kinds[s] == "chitchat"], free(far), free(later), list(later)), b)
        out = [("Point_A", a, 0)]
        if at is None:
            return out
        out.append(("Point_B", *at))
        between = range(a + 1, at[0])
        if distractor and (where := self._drawn((free(between), list(between)), d)):
            out.append(("Distractor", *where))
        return out

    def _drawn(self, rungs: tuple[list[int], ...], u: float) -> tuple[int, int] | None:
        for rung, some in enumerate(rungs):
            if some:
                at = some[int(u * len(some)) % len(some)]
                self.taken.add(at)
                return at, rung
        return None


def static_questions(points: DataFrame) -> DataFrame:
    """A question for each second statement (persona, session, conflict, field, value, first: the value stated before, or null)."""
    name = field_name(F.col("field"))
    known = F.concat(F.lit("There is conflicting information about the user's "), name, F.lit(". The correct value is "), F.col("first"), F.lit(", while another statement says "), F.col("value"), F.lit("."))
    unknown = F.concat(F.lit("The information is inconsistent for "), name, F.lit(". Another statement says "), F.col("value"), F.lit(". The correct value cannot be confirmed from the available context."))
    place = F.row_number().over(Window.partitionBy("persona", "session").orderBy("conflict", "field"))
    return points.select("persona", "session", F.format_string("Q_%03d", place).alias("question_id"), F.concat(F.lit("What is the user's "), name, F.lit("?")).alias("question"), F.coalesce(known, unknown).alias("answer"), F.lit("static_conflict").alias("conflict_type"), F.lit("hard").alias("difficulty"))


def conditional_questions(points: DataFrame) -> DataFrame:
    """A question at each later point (persona, session, conflict, role, kind, item, condition) about the one told before it, or about itself where none was."""
    order = Window.partitionBy("persona", "conflict").orderBy("role", "session")
    told = points.withColumn("last", F.lag(F.struct("role", "kind", "item", "condition")).over(order)).where("role <> 'Point_A'")
    pick = lambda c: F.coalesce(F.col(f"last.{c}"), F.col(c))
    question = F.concat(F.lit("For the user's "), pick("kind"), F.lit(', under what condition is "'), pick("item"), F.lit('" preferred or selected?'))
    answer = F.concat(F.lit("For the user's "), pick("kind"), F.lit(", "), pick("item"), F.lit(" is associated with the condition "), pick("condition"), F.lit("."))
    place = F.row_number().over(Window.partitionBy("persona", "session").orderBy("conflict", "role"))
    return told.select("persona", "session", F.format_string("Q_%03d", place).alias("question_id"), question.alias("question"), answer.alias("answer"), F.lit("conditional_conflict").alias("conflict_type"), F.lit("hard").alias("difficulty"))


def draws(pool: DataFrame, total: int, n: int, wanted: DataFrame) -> DataFrame:
    """persona, item, tokens and j: for each of the draws first to last of a persona (wanted: persona, first, last) an item,
    likelier the more tokens it has; pool has item, tokens and upto (tokens of all items before and it).

    A draw is a place among all tokens, by hash. Items stand in as many buckets of places as they reach into, about two
    in all for each item, so a draw meets the few items of its bucket alone.
    """
    width = max(1, total // n)
    held = pool.select("item", "tokens", "upto", F.explode(F.sequence(F.floor((F.col("upto") - F.col("tokens")) / width), F.floor((F.col("upto") - 1) / width))).alias("bucket"))
    at = wanted.select("persona", F.explode(F.sequence("first", "last")).alias("j"))
    at = at.withColumn("x", F.least(F.floor(hash_unit(F.col("persona"), F.col("j"), F.lit("draw")) * total), F.lit(total - 1)).cast("long"))
    met = at.withColumn("bucket", F.floor(F.col("x") / width)).join(held, "bucket")
    return met.where((F.col("x") < F.col("upto")) & (F.col("x") >= F.col("upto") - F.col("tokens"))).select("persona", "item", "tokens", "j")


def supplements(items: DataFrame, needs: DataFrame, rounds: int = 5) -> DataFrame:
    """persona, item, tokens and place: for each persona (needs: persona, tokens) items (item, tokens) drawn without
    repeats, longer ones likelier, until they have the tokens it needs; the last one passes the need.

    Draws with repeats, of which the first of each item counts, are draws without. A persona gets about as many as items
    of the mean length would do, and twice as many in each further round; so rows grow with what is needed, not with
    personas times items. Who needs all items, or still lacks tokens after the last round as it needs nearly all, gets the rest in the
    order of keys -ln(u) / weight, which goes on with the same draw. Items and personas differ; ties go to the smaller item.
    """
    pool = stored(running(items.where("tokens > 0").select("item", F.col("tokens").cast("long").alias("tokens")), [], ["item"], F.col("tokens"), "upto"))
    total, n = pool.agg(F.sum("tokens"), F.count("*")).first()
    each = needs.where("tokens > 0").select("persona", F.col("tokens").cast("long").alias("need"))
    if not n:
        return each.join(pool.select("item", "tokens"), F.lit(False)).select("persona", "item", "tokens", F.lit(0).alias("place"))
    left = stored(each.where(F.col("need") < total).withColumns({"first": F.lit(0).cast("long"), "last": F.ceil(F.col("need") * n / total).cast("long") + 3}))
    done, seen = [], None
    for _ in range(rounds):
        new = draws(pool, total, n, left)
        every = (new if seen is None else seen.join(left.select("persona"), "persona", "left_semi").unionByName(new)).groupBy("persona", "item", "tokens").agg(F.min("j").alias("j"))
        seen = running(every, ["persona"], ["j"], F.col("tokens"), "sum")
        seen = stored(seen.join(left.select("persona", "need"), "persona").where(F.col("sum") - F.col("tokens") < F.col("need")))
        enough = seen.groupBy("persona").agg(F.max("sum").alias("has"), F.max("need").alias("n")).where("has >= n").select("persona")
        done.append(seen.join(enough, "persona", "left_semi").select("persona", "item", "tokens", "j"))
        left = stored(left.join(enough, "persona", "left_anti").select("persona", "need", (F.col("last") + 1).alias("first"), (2 * F.col("last") + 1).alias("last")))
        seen = seen.select("persona", "item", "tokens", "j")
        if not left.limit(1).count():
            break
    rest = left.select("persona", "need").unionByName(each.where(F.col("need") >= total))
    if rest.limit(1).count():
        had = seen.join(left.select("persona"), "persona", "left_semi")
        # all items for each of these: it is what they get, but for the few that go beyond the need
        more = rest.crossJoin(F.broadcast(pool) if n <= 100_000 else pool).join(had.select("persona", "item"), ["persona", "item"], "left_anti")
        key = -F.ln(F.greatest(hash_unit(F.col("persona"), F.col("item"), F.lit("rest")), F.lit(1e-12))) / F.col("tokens")
        more = more.select("persona", "need", "item", "tokens", F.lit(1 << 62).alias("j"), key.alias("key")).unionByName(had.join(rest, "persona").select("persona", "need", "item", "tokens", "j", F.lit(0.0).alias("key")))
        done.append(running(more, ["persona"], ["j", "key", "item"], F.col("tokens"), "sum").where(F.col("sum") - F.col("tokens") < F.col("need")).select("persona", "item", "tokens", F.struct("j", "key", "item").alias("o")))
    order = [df if "o" in df.columns else df.select("persona", "item", "tokens", F.struct("j", F.lit(0.0).alias("key"), "item").alias("o")) for df in done]
    return reduce(DataFrame.unionByName, order).select("persona", "item", "tokens", (F.row_number().over(Window.partitionBy("persona").orderBy("o")) - 1).alias("place"))


def new_sessions(drawn: DataFrame, target: int) -> DataFrame:
    """drawn (persona, item, tokens, place) with group: items in order go together until the next would pass `target` tokens; a
    larger one is alone. Groups become new sessions; a persona's items stream by."""
    dealt = drawn.select("persona", "item", "tokens", "place").repartition("persona").sortWithinPartitions("persona", "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, group, size = None, 0, 0
        for b in batches:
            groups = []
            for persona, tokens in zip(b.persona, b.tokens, strict=True):
                if persona != at:
                    at, group, size = persona, 0, 0
                elif size and size + tokens > target:
                    group, size = group + 1, 0
                size += tokens
                groups.append(group)
            yield b.assign(group=groups)

    return dealt.mapInPandas(run, dealt.withColumn("group", F.lit(0).cast("long")).schema)


def renumbered(sessions: DataFrame, added: DataFrame) -> DataFrame:
    """persona, number, old (null for a new one) and group: sessions (persona, session) with the new ones (persona, group) put
    among them by hash, all numbered from 0; old ones keep their order."""
    old = sessions.select("persona", F.col("session").cast("double").alias("at"), F.col("session").cast("long").alias("old"), F.lit(None).cast("long").alias("group"))
    span = sessions.groupBy("persona").agg(F.max("session").alias("last"))
    new = added.select("persona", "group").distinct().join(span, "persona").select("persona", (hash_unit(F.col("persona"), F.col("group"), F.lit("insert")) * F.col("last")).alias("at"), F.lit(None).cast("long").alias("old"), "group")
    order = Window.partitionBy("persona").orderBy("at", F.col("old").isNull(), "group")
    return old.unionByName(new).select("persona", (F.row_number().over(order) - 1).cast("long").alias("number"), "old", "group")
