"""URL filters: pattern rules found by their rarest literal token.

A rule has a regular expression and the literal tokens that every URL it fits must
contain as whole tokens (runs of ASCII letters and digits, lower-cased). Rules are
indexed by whichever of their tokens is rarest in the URLs at hand. The tokens of a
URL fetch candidate rules from the index, and only those run their expression.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ALLOW, BLOCK = "allow", "block"

_TOKENS = re.compile(r"[a-z0-9]+").findall
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)").search
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in the host and the path behind it; a host has no slash."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]


def site_rule(verdict: str, name: str) -> Rule:
    """``host/path``: fits the host and all its subdomains if the path starts with ``/path``."""
    host, slash, path = name.partition("/")
    host, path = host.translate(_LOWER), slash + path
    # The last token of the path may go on in the URL, so it counts only before a separator.
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.translate(_LOWER))
    return Rule(name, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*_TOKENS(host), *whole))


def host_word_rule(verdict: str, word: str) -> Rule:
    """Fits hosts in which ``word`` stands between separators or ends."""
    return Rule(word, verdict, rf"\A(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?:[^a-z0-9/][^/]*)?(?:/|\Z)", tuple(_TOKENS(word)))


#: What is blocked where no rule says otherwise.
DEFAULT_RULES = tuple(host_word_rule(BLOCK, w) for w in ("spam-farm", "casino", "porn", "phishing", "malware", "warez"))


def host_and_path(url: str | None) -> tuple[str, str]:
    """The host, lower-cased in A-Z, and the path; both empty without '://'."""
    found = _PARTS(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def url_tokens(host: str, path: str) -> set[str]:
    return set(_TOKENS(f"{host}/{path}".translate(_LOWER)))


class RuleIndex:
    """Rules by their rarest literal; those without a literal are tried on every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: defaultdict[str, list] = defaultdict(list)
        self.always: list = []
        for rule in rules:
            entry = (len(rule.name), rule.verdict == BLOCK, rule.name, rule.verdict, re.compile(rule.pattern))
            if rule.literals:
                self.by_token[min(rule.literals, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def best(self, host: str, path: str, tokens: set[str]) -> tuple | None:
        """The longest rule that fits; a block among rules of one length."""
        subject, best = host + path, None
        for entries in (self.always, *(self.by_token[t] for t in tokens if t in self.by_token)):
            for entry in entries:
                if (best is None or entry[:3] > best[:3]) and entry[4].search(subject):
                    best = entry
        return best


def literal_counts(pages: DataFrame, url_col: str, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each literal of the rules is a token."""
    wanted = frozenset(t for r in rules for t in r.literals)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(url_tokens(*host_and_path(url)) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    counted = pages.select(F.col(f"`{url_col}`").cast("string").alias("url")).mapInArrow(count, "token string, n long")
    # At most one row per literal of the rules.
    return {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


_RESULT = T.StructType().add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")
_RESULT_ARROW = pa.struct([(n, pa.string()) for n in ("host", "path", "rule", "verdict")])


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    fallback: list[Rule] | tuple[Rule, ...] = DEFAULT_RULES,
    url_col: str = "url",
    result: str = "judged",
) -> DataFrame:
    """All columns and a struct ``result``: ``host``, ``path``, ``rule``, ``verdict``.

    The longest fitting rule decides and is named; a block wins among rules of one
    length. Where none fits, ``rule`` is null, the longest fitting ``fallback`` rule
    decides, and else the URL is allowed. A null URL, or one without '://', has an
    empty host and path. Every row is judged by itself, so repeated rows stay and the
    result is as long as the input. A column called like ``result`` is replaced.
    """
    counts = literal_counts(pages, url_col, [*rules, *fallback])
    # The rules come from the caller's own memory and go to the tasks as they are.
    shared = pages.sparkSession.sparkContext.broadcast((list(rules), list(fallback), counts))

    @F.arrow_udf(_RESULT)
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, other, seen = shared.value
        first, second = RuleIndex(own, seen), RuleIndex(other, seen)
        for urls in parts:
            out = []
            for url in urls.to_pylist():
                host, path = host_and_path(url)
                tokens = url_tokens(host, path)
                fits = first.best(host, path, tokens)
                decided = fits or second.best(host, path, tokens)
                out.append({"host": host, "path": path, "rule": fits and fits[2], "verdict": decided[3] if decided else ALLOW})
            yield pa.array(out, _RESULT_ARROW)

    return pages.withColumn(result, judge(F.col(f"`{url_col}`").cast("string")))
