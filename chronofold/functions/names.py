"""Names: projects from remotes, scripts of text, tails that say when, echoes of instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that do not tell owners and repositories apart by case.
FOLDED_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")


def project_of(remote: Column) -> Column:
    """host/owner/repo of a git remote, null where it names none. Credentials, suffix, query and empty segments go; ports and nested groups stay."""
    url = F.regexp_replace(F.trim(F.regexp_replace(remote, r"[\r\n\t]", " ")), r"[?#].*$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    with_scheme = F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/@]+)/", 1), F.regexp_replace(rest, r"^[^/]*/?", "")
    scp = F.regexp_extract(url, r"^(?:[^/@:]+@)?([^/@:\\]{2,}):(?!/)[^\\]", 1), F.regexp_replace(url, r"^[^:]*:", "")
    host = F.lower(F.when(scheme == "", scp[0]).when(scheme == "file", "").otherwise(with_scheme[0]))
    path = F.when(scheme == "", scp[1]).otherwise(with_scheme[1])
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.git$", ""), "/"), lambda p: p != "")
    parts = F.when(host.isin(list(FOLDED_HOSTS)), F.transform(parts, lambda p: F.lower(p))).otherwise(parts)
    return F.when((host != "") & (F.size(parts) >= 1), F.concat_ws("/", host, F.array_join(parts, "/")))


# Ranges of the scripts that are told apart.
SCRIPTS = {"latin": r"[\p{IsLatin}]", "cyrillic": r"[\p{IsCyrillic}]", "greek": r"[\p{IsGreek}]", "arabic": r"[\p{IsArabic}]", "hebrew": r"[\p{IsHebrew}]", "han": r"[\p{IsHan}]", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"[\p{IsHangul}]", "devanagari": r"[\p{IsDevanagari}]", "thai": r"[\p{IsThai}]"}


def script(text: Column, head: int = 128) -> Column:
    """The script that most letters of the first 128 characters are of; null without letters. Identification by a head is the feature here."""
    part = F.substring(text, 1, head)
    counts = F.array(*(F.struct(F.regexp_count(part, F.lit(p)).alias("n"), F.lit(name).alias("name")) for name, p in SCRIPTS.items()))
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["name"])


_WHEN = r"\s+(yesterday|(?:last|this|next) [a-z]+|(?:\d+|[a-z]+) (?:day|week|month|year)s? ago|in \d{4}|now|today|currently)$"


def split_when(value: Column) -> Column:
    """struct(value, said_when): the tail that says when, taken off."""
    return F.struct(F.regexp_replace(value, f"(?i){_WHEN}", "").alias("value"), F.nullif(F.regexp_extract(value, f"(?i){_WHEN}", 1), F.lit("")).alias("said_when"))


def echoes(text: Column, instructions: list[str], share: float = 0.75) -> Column:
    """Whether a text repeats an instruction: three quarters of the words of one, of four words at least."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1))
    out = F.lit(False)
    for line in instructions:
        own = F.array_distinct(F.regexp_extract_all(F.lower(F.lit(line)), F.lit(r"([a-z0-9]+)"), 1))
        out = out | ((F.size(own) >= 4) & (F.size(F.array_intersect(words, own)) >= share * F.size(own)))
    return out
