"""Secret scans: single credentials by pattern, weak parts by an interval join with their complements."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.common import packed, settle, small_enough, text_key

#: Fixed by the contract: patterns of the kinds that always count, in the order of the list.
BASE = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Weak parts: too common on their own. Kind, role, pattern.
WEAK = [
    ("account", "access", r"(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._+-]{3,}"),
    ("endpoint", "endpoint", r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/@%?&=+-]+"),
    ("host", "endpoint", r"(?:host|server|endpoint|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:/_-]{3,}"),
    ("key", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]{0,39}[0-9])(?=[A-Za-z0-9+/_-]{0,39}[A-Z])[A-Za-z0-9+/_-]{40}={0,2}(?![A-Za-z0-9+/_=-])"),
    ("phrase", "secret", r"(?:pass(?:word|wd|phrase)?|pwd|secret|private_?key)[\"']?\x20*[:=]\x20*[\"']?[^\x20\x09-\x0D\"',;]{4,}"),
]
KINDS = [*BASE, *[k for k, _, _ in WEAK]]
ROLE = {"assign": "secret", "access": "access", "hex": "secret", **{k: r for k, r, _ in WEAK}}
#: Roles that make a weak part of a role a finding.
COMPLEMENTS = {"access": ["secret"], "secret": ["access", "endpoint"], "endpoint": ["secret"]}
#: Characters over which parts belong together; blank lines part the scopes.
REACH = 400
#: Every finding is of a base kind or linked to a secret, so texts with none of these (in lower case) and no long run have none.
SIGNS, RUN = ["pass", "pwd", "secret", "token", "api_key", "apikey", "private", "akia"], r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32}"
#: Texts with findings up to which these are broadcast to the texts.
SMALL = 200_000
#: Texts that a worker holds as Python strings at once.
BLOCK = 500

PARTS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("stop", "integer").add("scope", "integer"))
PARTS_ARROW = [pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("scope", pa.int32())]))]


def find_parts(text: str) -> list[tuple]:
    """(kind, start, stop, scope) in code points. Base kinds: leftmost matches that do not overlap, short ones
    dropped. Weak parts inside a match of a base kind are not parts of their own."""
    gaps = [m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    found, covered = [], []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                found.append((kind, m.start(), m.end()))
    covered = sorted((s, e) for _, s, e in found)
    for kind, _, pattern in WEAK:
        at = 0
        for m in re.finditer(pattern, text, re.ASCII | re.IGNORECASE if kind != "key" else re.ASCII):
            while at < len(covered) and covered[at][1] <= m.start():
                at += 1
            if at == len(covered) or covered[at][0] >= m.end():
                found.append((kind, m.start(), m.end()))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    out, scope = [], 0
    for kind, s, e in found:
        while scope < len(gaps) and gaps[scope] <= s:
            scope += 1
        out.append((kind, s, e, scope))
    return out


def _parts(batches):
    """(_key, p) of the texts that have parts, a few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            keys, texts = (c.to_pylist() for c in b.slice(at, BLOCK).columns)
            rows = [(k, [dict(zip(PARTS.elementType.names, x)) for x in p]) for k, p in zip(keys, map(find_parts, texts)) if p]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PARTS_ARROW)], ["_key", "p"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) as ``row``, with ``base`` and ``spans``: arrays of (start, no, kind, stop) in order.

    Regular expressions find the parts. Base kinds are findings. A weak part is one only if a part that
    complements its role starts within REACH characters of it in the same scope. That interval join runs over bins of
    REACH characters: a bin is summed up by its first and last start per role, so a part meets three summaries
    and never its neighbours one by one. Texts with no sign of a secret skip all that; null text is empty. Findings are
    broadcast to the rows if at most SMALL texts have some, else joined by a shuffle.
    Equal rows get equal findings; rows are told apart by id and text."""
    d = packed(docs).withColumn("_key", text_key(F.col("row.doc_id"), F.col("row.text")))
    signs = F.col("row.text").rlike(RUN)
    for x in SIGNS:
        signs = signs | F.lower("row.text").contains(x)
    # a UDF whose result is filtered would run twice on each text, in two workers a task: the filter is inside
    found = (d.filter(signs).select("_key", F.col("row.text").alias("_text")).mapInArrow(_parts, T.StructType().add("_key", "string").add("p", PARTS))
             .groupBy("_key").agg(F.first("p").alias("p"))
             .select("_key", F.explode("p").alias("p")).select("_key", "p.*")
             .withColumn("role", _of(ROLE)).withColumn("bin", F.floor(F.col("start") / REACH))
             .withColumn("weak", ~F.col("kind").isin(*BASE)))
    bins = (found.groupBy("_key", "scope", F.col("role").alias("other"), F.col("bin").alias("_bin"))
            .agg(F.min("start").alias("lo"), F.max("start").alias("hi")))
    wants = F.create_map(*[x for r, c in COMPLEMENTS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    probes = (found.filter("weak").withColumn("other", F.explode(wants[F.col("role")]))
              .withColumn("_bin", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1))))
    near = (F.col("lo") <= F.col("start") + REACH) & (F.col("hi") >= F.col("start") - REACH)
    linked = (probes.join(bins, ["_key", "scope", "other", "_bin"]).filter(near)
              .groupBy("_key", "kind", "start", "stop").agg(F.first("scope").alias("scope")))
    span = F.struct("start", _of({k: i for i, k in enumerate(KINDS)}).alias("no"), "kind", "stop")
    spans = (found.filter("not weak").select("_key", "kind", "start", "stop")
             .unionByName(linked.select("_key", "kind", "start", "stop"))
             .groupBy("_key").agg(F.array_sort(F.collect_list(span)).alias("spans")))
    spans = settle(spans, "secrets")
    none = F.array().cast(dict(spans.dtypes)["spans"])
    return (d.join(small_enough(spans, SMALL), "_key", "left").drop("_key").withColumn("spans", F.coalesce("spans", none))
            .withColumn("base", F.filter("spans", lambda s: s["no"] < len(BASE))))


def _of(values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("kind")]


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("row.doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                    listed(F.col("spans")).alias("spans"))


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def one(text, found):
        out, at = [], 0
        for s in found:
            if s["stop"] > at:
                if s["start"] >= at:
                    out += [text[at:s["start"]], f"[{s['kind']}]"]
                at = s["stop"]
        return "".join(out) + text[at:]
    return pd.Series([one(t, s) for t, s in zip(texts, spans)])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every finding replaced by its kind in brackets and n_chars counted anew; no row is dropped."""
    d = scan(docs)
    hit = F.size("spans") > 0
    text = F.when(hit, _masked(F.when(hit, F.col("row.text")).otherwise(""), "spans")).otherwise(F.col("row.text"))
    d = d.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        d = d.withColumn("row", F.when(hit, F.col("row").withField("n_chars", F.length("row.text").cast("long"))).otherwise(F.col("row")))
    return d.select("row.*")
