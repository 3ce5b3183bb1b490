"""The store as one object: assertions in versions of Parquet, and the verbs over them.

Each write makes a new version from the old one by DataFrame operations and commits it; reads are plain queries over the current
version. Batches of assertions go in at once: a version costs one pass, whether it adds one row or a billion.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import secrets
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import clocks as C
from chronofold.functions.language import extract_facts
from chronofold.functions.text import ascii_tokens
from chronofold.operators import maintenance as M
from chronofold.operators import reconcile as RC
from chronofold.operators import temporal as T
from chronofold.sources.vocabulary import Vocabulary

SCHEMA = "tenant string, usr string, subject string, id string, predicate string, object string, polarity int, valid_from timestamp_ntz, arrived_at timestamp_ntz, confidence double, expires_at timestamp_ntz, sources array<string>, closes string, how string, reason string"
CONFIRM_WITHIN, REASON_LENGTH = timedelta(minutes=10), 500
_SECRET = secrets.token_bytes(32)


class Memory:
    """A store under a root folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, vocabulary: Vocabulary | None = None, tenant: str = "default", user: str | None = None, secret: bytes = _SECRET):
        self.spark, self.root, self.vocabulary = spark, root.rstrip("/"), vocabulary or Vocabulary()
        self.tenant, self.user, self.secret = tenant, user, secret

    def scope(self, user: str) -> Memory:
        """The same store, bound to a user."""
        return Memory(self.spark, self.root, self.vocabulary, self.tenant, user, self.secret)

    @staticmethod
    def _now():
        return datetime.now(UTC).replace(tzinfo=None)

    def _version(self) -> int:
        return max(M.versions(self.spark, self.root), default=0)

    def _inside(self) -> Column:
        """Rows within scope; never null."""
        mine = F.col("tenant") == self.tenant
        return F.coalesce(mine if self.user is None else mine & (F.col("usr") == self.user), F.lit(False))

    def assertions(self) -> DataFrame:
        """Everything ever said, within scope."""
        return self._all().filter(self._inside())

    def _save(self, df: DataFrame) -> None:
        M.save(df, self.root, self._version() + 1)

    def _all(self) -> DataFrame:
        if not self._version():
            return self.spark.createDataFrame([], SCHEMA)
        rows = M.load(self.spark, self.root)
        # versions from before closures lack their columns
        return rows.withColumns({c: F.lit(None).cast("string") for c in ("closes", "how", "reason") if c not in rows.columns})

    def remember(self, rows: DataFrame | list[dict]) -> int:
        """Add assertions: subject, predicate, object and any of the other columns. Nobody can say when they were told but the store, nor speak for another user than the one it is bound to."""
        now = self._now()
        given = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([{"polarity": 1, "confidence": 1.0, **r} for r in rows])
        kinds = dict(x.strip().split(" ", 1) for x in SCHEMA.split(", "))
        told = F.least(F.coalesce(F.col("arrived_at").cast("timestamp_ntz"), F.lit(now)), F.lit(now)) if "arrived_at" in given.columns else F.lit(now)
        out = given
        for name, kind in kinds.items():
            out = out.withColumn(name, (F.col(name) if name in given.columns else F.lit(None)).cast(kind))
        out = out.withColumns({
            "tenant": F.lit(self.tenant), "usr": F.lit(self.user) if self.user is not None else F.col("usr"), "arrived_at": told, "polarity": F.coalesce("polarity", F.lit(1)), "confidence": F.coalesce("confidence", F.lit(1.0)),
            "valid_from": F.coalesce("valid_from", told), "sources": F.coalesce("sources", F.expr("cast(array() as array<string>)")),
        })
        stamp = F.sha2(F.concat_ws("\x1f", "tenant", "usr", "subject", "predicate", "object", F.col("polarity").cast("string"), F.col("valid_from").cast("string"), F.col("arrived_at").cast("string"), "closes"), 256)
        out = self.vocabulary.canonical(out).withColumn("id", F.coalesce("id", F.concat(F.lit("cl_"), F.substring(stamp, 1, 20)))).select(*kinds)
        fresh = out.filter("subject <> '' AND predicate <> ''").dropDuplicates(["id"]).join(self._all().select("id"), "id", "left_anti").select(*kinds)
        n = fresh.count()
        self._save(self._all().select(*kinds).unionByName(fresh))
        return n

    def add(self, turns: DataFrame) -> int:
        """Facts that turns (id, content, ts) of this user state plainly."""
        found = extract_facts(turns).select(F.lit("user").alias("subject"), "predicate", "object", "polarity", "valid_from", F.array(F.col("id").cast("string")).alias("sources"), F.lit(0.95).alias("confidence"))
        return self.remember(found)

    def claims(self) -> DataFrame:
        """The reconciled history: subject, predicate, object, the intervals and what closed them."""
        a = self.assertions()
        folded = RC.reconcile(a.withColumn("subject", F.concat_ws("\x1f", F.coalesce("usr", F.lit("")), "subject")), self.vocabulary.functional())
        own = a.select("id", "usr", F.col("arrived_at").alias("recorded_at"), "expires_at", "confidence", "sources", "polarity")
        return folded.withColumn("subject", F.substring_index("subject", "\x1f", -1)).join(own, "id").withColumn("fact_key", F.concat_ws("|", "usr", "subject", "predicate"))

    def get_all(self, states=(C.LIVE,), valid_at=None, known_at=None, as_of=None) -> DataFrame:
        if as_of is not None and (valid_at is not None or known_at is not None):
            raise ValueError("as_of sets both clocks")
        now = F.lit(self._now())
        v, k = (x if x is not None else as_of if as_of is not None else now for x in (valid_at, known_at))
        return T.read(self.claims(), states, k, v, now)

    def history(self, subject: str, predicate: str) -> DataFrame:
        name = self.vocabulary.resolve(predicate)[0]
        now = F.lit(self._now())
        return T.history(self.claims().filter((F.col("subject") == subject) & (F.col("predicate") == name)), now, now)

    def since(self, when) -> tuple[DataFrame, DataFrame]:
        now = F.lit(self._now())
        return T.delta(self.claims(), when, now, now)

    def forget(self, subject: str, predicate: str) -> int:
        """Say that a slot holds nothing any more."""
        return self.remember([{"subject": subject, "predicate": predicate, "object": "", "polarity": -1}])

    def get(self, claim: str) -> DataFrame:
        """The claim of this id, if it is within scope and has not expired; retired and ended ones too."""
        return self.claims().filter((F.col("id") == claim) & C.unexpired_expr(F.lit(self._now())))

    @staticmethod
    def _closure(claim: Row, close: str, at, reason: str | None, by: str = "") -> dict:
        return {"subject": claim.subject, "predicate": claim.predicate, "object": by, "polarity": -1, "usr": claim.usr, "valid_from": at, "closes": claim.id, "how": close, "reason": reason}

    def _told(self, rows: list[dict]) -> int:
        kinds = ", ".join(f"{n} {k}" for n, k in (x.strip().split(" ", 1) for x in SCHEMA.split(", ")) if any(n in r for r in rows))
        names = [x.split(" ", 1)[0] for x in kinds.split(", ")]
        return self.remember(self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds))

    @staticmethod
    def _checked(close: str, reason: str | None) -> None:
        if close not in ("ended", "retired"):
            raise ValueError("close is ended or retired")
        if reason is not None and not 0 < len(reason.strip()) <= REASON_LENGTH:
            raise ValueError(f"a reason has 1 to {REASON_LENGTH} characters")

    def delete(self, claim: str, at=None, close: str = "retired", reason: str | None = None) -> bool:
        """Close one claim; whether the scope has it. One that is retired already stays as it is. at: where the world's end lies (close="ended")."""
        self._checked(close, reason)
        found = self.get(claim).collect()
        if found and found[0].invalidated_at is None:
            self._told([self._closure(found[0], close, at or self._now(), reason)])
        return bool(found)

    def supersede(self, claim: str, new: dict, close: str = "ended", reason: str | None = None) -> str:
        """Put a new assertion in a claim's place, in one version; its id. Said again, it returns the successor that is there already.

        ended: the old claim held until the new one begins. retired: it was wrong, and belief in it stops now.
        """
        self._checked(close, reason)
        said = {"subject": None, "predicate": None, **new}
        heirs = self.assertions().filter(F.col("closes") == claim).select(F.col("object").alias("heir"))
        name = self.vocabulary.resolve(said["predicate"])[0] if said["predicate"] else None
        same = self.assertions().join(heirs, F.col("id") == F.col("heir")).filter(F.col("object") == new["object"])
        for r in same.select("id", "subject", "predicate").collect():
            if said["subject"] in (None, r.subject) and name in (None, r.predicate):
                return r.id
        found = self.get(claim).collect()
        if not found:
            raise KeyError(claim)
        old, now = found[0], self._now()
        row = {"usr": old.usr, "polarity": 1, **new, "subject": said["subject"] or old.subject, "predicate": said["predicate"] or old.predicate, "valid_from": new.get("valid_from") or now}
        row["id"] = "cl_" + hashlib.sha256(json.dumps([claim, {k: str(v) for k, v in sorted(row.items())}]).encode()).hexdigest()[:20]
        # a closure comes before what takes the claim's place: its id sorts first among what is told at one instant
        self._told([{**self._closure(old, close, row["valid_from"] if close == "ended" else now, reason, row["id"]), "id": "cc_" + row["id"][3:]}, row])
        return row["id"]

    def matching(self, query: str, k: int = 20, close: str = "retired") -> tuple[list[Row], str]:
        """The k live claims that hold most of the query's words, and a token that confirms closing just these within CONFIRM_WITHIN."""
        self._checked(close, None)
        asked = F.array_distinct(ascii_tokens(F.lit(query)))
        held = F.size(F.array_intersect(ascii_tokens(F.concat_ws(" ", "subject", F.translate("predicate", "_", " "), "object")), asked))
        hits = self.get_all().withColumn("words", held).filter("words > 0").orderBy(F.desc("words"), "id").limit(k).collect()
        body = json.dumps({"close": close, "until": (self._now() + CONFIRM_WITHIN).isoformat(), "ids": sorted(r.id for r in hits), "root": self.root, "user": self.user}, sort_keys=True)
        return hits, body + "\n" + hmac.new(self.secret, body.encode(), hashlib.sha256).hexdigest()

    def forget_matching(self, token: str, close: str = "retired", reason: str | None = None) -> int:
        """Close what matching() showed, all or nothing: a token that is altered, late, for another closure, scope or store, or names a claim that is live no more, closes none."""
        self._checked(close, reason)
        body, _, mark = token.rpartition("\n")
        if not hmac.compare_digest(mark, hmac.new(self.secret, body.encode(), hashlib.sha256).hexdigest()):
            raise PermissionError("this token was not issued here")
        said = json.loads(body)
        if (said["close"], said["root"], said["user"]) != (close, self.root, self.user):
            raise PermissionError("this token was issued for something else")
        if datetime.fromisoformat(said["until"]) <= self._now():
            raise PermissionError("this token is too old")
        hits = self.get_all().filter(F.col("id").isin(said["ids"])).collect()
        if len(hits) < len(said["ids"]):
            raise LookupError("some of the claims are live no more")
        now = self._now()
        return self._told([self._closure(r, close, now, reason) for r in hits]) if hits else 0

    def erase(self, ids: list[str]) -> int:
        """Remove assertions within scope for good, closures that name them and old versions included; returns the rows of the scope that still mention them (0)."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        named = gone.select(F.col("id").alias("_gone"))
        rest = self._all()
        for column in ("id", "closes"):
            rest = rest.join(named, (F.col(column) == F.col("_gone")) & self._inside(), "left_anti")
        self._save(rest.withColumn("object", F.when(F.col("closes").isNotNull() & F.col("object").isin(ids), "").otherwise(F.col("object"))))
        M.expunge(self.spark, self.root)
        return M.proof({"claims": (self.assertions(), "id")}, gone).first().residue

    def erase_expired(self) -> None:
        now = self._now()
        self._save(self._all().filter(~self._inside() | C.unexpired_expr(F.lit(now))))
        M.expunge(self.spark, self.root)

    def stats(self) -> DataFrame:
        return self.claims().groupBy(C.stored_state().alias("state")).agg(F.count(F.lit(1)).alias("n"))
