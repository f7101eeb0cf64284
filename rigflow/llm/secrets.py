"""Secret scan: fixed patterns, and strings that a primed compressor finds new.

The patterns (assignments to sensitive names, access keys, long hex) give base spans.  The
method adds strings in a sensitive context, such as a name on ``CONTEXT`` or a header of that
kind, that zstandard cannot shorten: the marginal compressed bytes of a candidate are the size
of (surroundings + candidate) less the size of the surroundings, both compressed with a
dictionary primed with code and the identifiers that the corpus itself uses most.  A candidate
whose marginal bits per character stay above ``NOVEL_BITS`` is reported as kind "novel".
Ordinary words, paths and identifiers are in the dictionary or in the surroundings and cost
little; keys are new.

The identifiers are counted over all documents: tokens that look like identifiers (snake or
camel case) are rare in text, are summed within each task first, and the ``IDENTIFIERS`` most
used of at least three documents go into the dictionary.  What stands inside a candidate is not
counted, and a random-looking token that does so in any document is no identifier, so a key in
many copies stays new.  Nor do other occurrences of a candidate in its surroundings count.

Defined results: null is an empty text without spans; positions are code points, end exclusive;
a novel span that overlaps a base span is not reported; spans are ordered by start, then by
kind as listed in ``KINDS``.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import free_name

KINDS = ("assign", "access", "hex", "novel")
IDENTIFIERS = 2_000
NOVEL_BITS = 4.0
LEAST = 12                     # characters of a candidate
AROUND = 200                   # characters of surroundings on each side

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")      # maximal runs, so the same as all runs of which short ones are dropped
#: A name of something secret shortly before a candidate.
CONTEXT = re.compile(r"(?i:bearer|basic|authorization|auth|credential|private|access|client|signing|session|cookie|secret|token|passwd|password|passphrase|pwd|apikey|api_key|api-key|key|aws|akia|ssh-rsa)"
                     r"[A-Za-z0-9_\x20\"'-]{0,24}[\"':=\x20]{1,4}$", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.$-]{12,}")
IDENTIFIER = re.compile(r"\b[A-Za-z]+_[A-Za-z0-9_]+\b|\b[a-z]+[A-Z][A-Za-z0-9]+\b", re.ASCII)
#: What code commonly looks like around a name and its value.
CODE = ('import os\nfrom config import settings\ndef main(args):\n    return self.client.get(url, headers={"Authorization": "Bearer "})\n'
        'class Config:\n    username = "user"\n    password = os.environ["PASSWORD"]\n    secret_key = None\n    access_token = ""\n    api_key = "your-api-key-here"\n'
        'export AWS_ACCESS_KEY_ID=\nexport AWS_SECRET_ACCESS_KEY=\nconst clientSecret = process.env.CLIENT_SECRET;\npublic static final String PRIVATE_KEY = "changeme";\n'
        'http://localhost:8080/ https://www.example.com/index.html abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxx\n')


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the pattern matches."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Novelty:
    """Marginal compressed bytes under a primed dictionary."""

    def __init__(self, identifiers: list[str]):
        primed = CODE + "\n".join(reversed(identifiers))          # what is nearest the end is cheapest
        self._raw = primed.encode()
        self._press = None

    def __getstate__(self):
        return {"_raw": self._raw, "_press": None}

    def _size(self, data: bytes) -> int:
        if self._press is None:
            dictionary = zstandard.ZstdCompressionDict(self._raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._press = zstandard.ZstdCompressor(level=19, dict_data=dictionary, write_content_size=False, write_checksum=False)
        return len(self._press.compress(data))

    def bits(self, before: str, candidate: str, after: str) -> float:
        """Marginal bits per character of the candidate among its surroundings."""
        around = (before + after + "\n" + before).encode("utf-8", "surrogatepass")
        return 8.0 * (self._size(around + candidate.encode()) - self._size(around)) / len(candidate)


def _looks_random(s: str) -> bool:
    """Holds two of lower case, upper case and digits at least, and a digit or frequent changes
    of case: names in camel case change seldom."""
    lower, upper, digit = any(map(str.islower, s)), any(map(str.isupper, s)), any(map(str.isdigit, s))
    if lower + upper + digit < 2:
        return False
    return digit or 2.5 * sum(x.islower() != y.islower() for x, y in zip(s, s[1:])) >= len(s)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Random-looking strings in a sensitive context: start and end.

    What is joined by ``=`` is split where a value of full length follows: its name, and what
    stands before the name, are both its context.  ``=`` at the end is padding.
    """
    sensitive = lambda at: CONTEXT.search(text[max(0, at - 48):at])
    for m in CANDIDATE.finditer(text):
        first, end = m.span()
        stop, a = first + len(m.group().rstrip("=")), first
        cuts = []
        while (cut := text.find("=", a, stop)) >= 0 and end - cut - 1 >= LEAST:
            if cut - a >= LEAST:
                cuts.append((a, cut))
            a = cut + 1
        for a, b in [*cuts, (a, end)]:
            if _looks_random(text[a:b]) and (sensitive(a) or a != first and sensitive(first)):
                yield a, b


def _surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    """What stands around text[a:b], without its other occurrences, also those that the edge would cut."""
    own, wide = text[a:b], AROUND + b - a
    core = own.strip("+/_=.$-")
    core = core if len(core) >= LEAST else own
    blank = lambda t: t.replace(core, " ")
    return blank(text[max(0, a - wide):a])[-AROUND:], blank(text[b:b + wide])[:AROUND]


def all_spans(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    """Base spans and novel ones, in order."""
    if not text:
        return []
    spans = base_spans(text)
    taken = spans[:]
    for a, b in candidates(text):
        if any(x < b and a < y for x, _, y in taken):
            continue
        before, after = _surroundings(text, a, b)
        if novelty.bits(before, text[a:b], after) >= NOVEL_BITS:
            spans.append((a, 3, b))
    return sorted(spans)


def _names(text: str) -> tuple[set[str], set[str]]:
    """The identifiers of a text outside of candidates, and the random-looking ones inside."""
    plain, hidden, spans, k = set(), set(), list(candidates(text)), 0
    for m in IDENTIFIER.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or m.end() <= spans[k][0]:
            plain.add(m.group())
        elif _looks_random(m.group()):
            hidden.add(m.group())
    return plain, hidden


def _count_identifiers(batches):
    seen: Counter = Counter()
    secret: set[str] = set()

    def counted():
        names = [*seen, *secret.difference(seen)]
        return pd.DataFrame({"name": names, "n": [seen[x] for x in names], "secret": [x in secret for x in names]}).astype({"name": object, "n": "int64", "secret": bool})

    for b in batches:
        for text in b["text"]:
            if text and ("_" in text or not text.islower()):
                plain, hidden = _names(text)
                seen.update(plain)
                secret |= hidden
        if len(seen) + len(secret) > 500_000:
            yield counted()
            seen.clear()
            secret.clear()
    yield counted()


def identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> list[str]:
    """The identifiers that most documents use, counted over all of them; the list is bounded."""
    counts = docs.select("text").mapInPandas(_count_identifiers, "name string, n long, secret boolean").groupBy("name").agg(F.sum("n").alias("n"), F.max("secret").alias("secret"))
    top = counts.where("n >= 3 AND length(name) <= 40 AND NOT secret").orderBy(F.desc("n"), "name").limit(most)
    return [r["name"] for r in top.collect()]


def scan(docs: DataFrame, novelty: Novelty) -> DataFrame:
    """``docs`` with spans: array<struct<kind, start, end>>; row by row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(novelty)      # the dictionary, of bounded size

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(t, shared.value)] for t in texts], dtype=object)

    name = free_name(docs, "found")
    return docs.withColumn(name, find("text")).withColumn("spans", F.col(name)).drop(*([name] if name != "spans" else []))


def op9_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, Novelty(identifiers(docs)))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
