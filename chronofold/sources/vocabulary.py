"""The predicate vocabulary: how many values a predicate takes, how fast they fade, and how raw names resolve to known ones.

It is a small dimension (some dozen rows, at most MAX_LEARNED more), built on the driver and joined to claims as a broadcast.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LEARNED = 200

# Half-lives in days by volatility.
HALF_LIFE = {"static": 36500, "slow": 730, "fast": 7}

# Predicate, cardinality, volatility, memory type.
BUILTIN = [
    ("name", "one", "static", "semantic"), ("born_on", "one", "static", "semantic"), ("born_in", "one", "static", "semantic"), ("pronouns", "one", "static", "semantic"),
    ("lives_in", "one", "slow", "semantic"), ("works_at", "one", "slow", "semantic"), ("job_title", "one", "slow", "semantic"), ("timezone", "one", "slow", "semantic"), ("relationship_status", "one", "slow", "semantic"),
    ("prefers_tool", "one", "slow", "procedural"), ("communication_style", "one", "slow", "procedural"), ("working_on", "one", "fast", "episodic"), ("mood", "one", "fast", "semantic"), ("located_now", "one", "fast", "semantic"),
    ("speaks", "many", "static", "semantic"), ("allergic_to", "many", "static", "semantic"), ("owns_pet", "many", "slow", "semantic"), ("likes", "many", "slow", "semantic"), ("dislikes", "many", "slow", "semantic"),
    ("dietary_restriction", "many", "slow", "semantic"), ("prefers", "many", "slow", "procedural"), ("never_do", "many", "slow", "procedural"), ("goal", "many", "fast", "episodic"),
]
# Words that change how a predicate is spelled and not what it asks, in the order in which they are taken off.
NOISE = (
    frozenset("name names value values field label info".split()),
    frozenset("is are was were be the a an of by at in on to for with my our your their user users current currently present".split()),
    frozenset("company job".split()),
)


@dataclass(frozen=True)
class Predicate:
    name: str
    cardinality: str = "many"
    volatility: str = "slow"
    memory_type: str = "semantic"
    aliases: tuple[str, ...] = ()

    @property
    def half_life(self) -> int:
        return HALF_LIFE[self.volatility]


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def _stem(word: str) -> str:
    word = _singular(word)
    for end in ("ation", "ment", "ing", "ion", "ed", "er", "or", "al"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


class Vocabulary:
    def __init__(self, extra: Iterable[Predicate] = ()):
        self.known: dict[str, Predicate] = {n: Predicate(n, *rest) for n, *rest in BUILTIN}
        self.learned = 0
        for p in extra:
            self.known[p.name] = p
        self._index()

    def _index(self) -> None:
        self.aliases = {a: p.name for p in self.known.values() for a in p.aliases}
        self.strict, self.loose = {}, {}
        for p in self.known.values():
            for table, key in ((self.strict, self.key(p.name)), (self.loose, self.key(p.name, _stem))):
                table[key] = p.name if table.get(key, p.name) == p.name else None

    @staticmethod
    def key(name: str, fold=_singular) -> tuple[str, ...]:
        words = "".join(c if c.isalnum() else " " for c in name.lower()).split()
        for noise in NOISE:
            words = [w for w in words if w not in noise] or words
        return tuple(sorted(map(fold, words)))

    def resolve(self, raw: str) -> tuple[str, str]:
        """(name, how): canonical, alias, strict, loose or novel. A key that two predicates share decides nothing."""
        name = "_".join("".join(c if c.isalnum() else " " for c in raw.lower()).split())
        if name in self.known:
            return name, "canonical"
        if name in self.aliases:
            return self.aliases[name], "alias"
        for how, table, key in (("strict", self.strict, self.key(name)), ("loose", self.loose, self.key(name, _stem))):
            if table.get(key):
                return table[key], how
        return name, "novel"

    def learn(self, p: Predicate) -> bool:
        """Add a predicate, unless there are MAX_LEARNED learned ones."""
        if p.name in self.known or self.learned >= MAX_LEARNED:
            return False
        self.known[p.name], self.learned = p, self.learned + 1
        self._index()
        return True

    def functional(self) -> set[str]:
        return {p.name for p in self.known.values() if p.cardinality == "one"}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.name, p.cardinality, p.volatility, p.memory_type, p.half_life) for p in self.known.values()]
        return spark.createDataFrame(rows, "predicate string, cardinality string, volatility string, memory_type string, half_life int")

    def canonical(self, claims: DataFrame) -> DataFrame:
        """Claims under resolved names. Only the distinct raw names come to the driver, and they are counted first."""
        raw = claims.select("predicate").distinct()
        if raw.limit(100_001).count() > 100_000:
            raise ValueError("over 100000 predicate names; resolve them as a column instead")
        pairs = [(r.predicate, self.resolve(r.predicate)[0]) for r in raw.collect() if r.predicate is not None]
        names = claims.sparkSession.createDataFrame(pairs, "predicate string, canonical string")
        return claims.join(F.broadcast(names), "predicate", "left").withColumn("predicate", F.coalesce("canonical", "predicate")).drop("canonical")

    def describe(self, claims: DataFrame) -> DataFrame:
        """Claims with cardinality, volatility and half-life; unknown predicates take many values and fade slowly."""
        dim = self.frame(claims.sparkSession).select("predicate", "cardinality", "volatility", "half_life")
        out = claims.join(F.broadcast(dim), "predicate", "left")
        return out.withColumns({"cardinality": F.coalesce("cardinality", F.lit("many")), "volatility": F.coalesce("volatility", F.lit("slow")), "half_life": F.coalesce("half_life", F.lit(HALF_LIFE["slow"]))})


def read_pack(text: str) -> list[Predicate]:
    """Predicates of a TOML vocabulary: tables by name with cardinality, volatility, memory_type and aliases."""
    data = tomllib.loads(text)
    tables: Mapping = data.get("predicates", data)
    return [Predicate(n, t.get("cardinality", "many"), t.get("volatility", "slow"), t.get("memory_type", "semantic"), tuple(t.get("aliases", ()))) for n, t in tables.items() if isinstance(t, Mapping)]
