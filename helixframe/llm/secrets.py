"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its text (the blob). The ledger holds the (blob, rule version)
pairs scanned so far; a run scans each blob once, and only for rule versions that the ledger lacks. Findings are stored
by blob and joined back to all paths and versions that hold it. The ledger is a folder: it outlives the session, and any later
run that names it goes on from there.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.storage import documents, shared_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; those with fewer than least characters in group are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


#: In the order in which findings at one place are listed. The last rule is not one of the base kinds.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,. \t\r\n-]*?-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
)
BASE = ("assign", "access", "hex")


def blob_id(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_text(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, int]]:
    """(start, place of the rule, end) of all findings in code points, end exclusive."""
    found = []
    for place, (rule, pattern) in enumerate(rules):
        found += [(m.start(), place, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return sorted(found)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blobs: (blob, text, todo array<string>), todo being the kinds to scan for. Returns (blob, todo, kinds, starts, ends) of each blob, the last three as parallel arrays."""
    names = [r.kind for r in rules]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))) for r in rules]
        for f in frames:
            rows = [scan_text(t, [x for x in ready if x[0].kind in set(todo)]) for t, todo in zip(f["text"], f["todo"], strict=True)]
            todo = [[n for n in names if n in set(t)] for t in f["todo"]]
            yield pd.DataFrame({"blob": f["blob"], "todo": todo, "kinds": [[k[p] for _, p, _ in r] for r, k in zip(rows, todo, strict=True)], "starts": [[s for s, _, _ in r] for r in rows], "ends": [[e for _, _, e in r] for r in rows]})

    return blobs.select("blob", "text", "todo").mapInPandas(run, "blob string, todo array<string>, kinds array<string>, starts array<long>, ends array<long>")


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
    """The distinct blobs of versions with the kinds not yet scanned: (blob, text, todo); blobs with nothing to do are left out.

    ledger: (blob, kind, version) of earlier runs, or None. Null texts are the empty blob. Copies meet as one blob before
    they are shuffled (partial aggregation), so that a blob with very many paths is no hot key.
    """
    blobs = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", kinds)
    current = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    done = ledger.where(F.try_element_at(current, F.col("kind")) == F.col("version")).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    todo = F.array_except(kinds, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def ledger_rows(scanned: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What to append to the ledger after a scan of unseen_blobs(): (blob, kind, version)."""
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    return scanned.select("blob", F.explode("todo").alias("kind")).withColumn("version", version[F.col("kind")])


def findings_by_path(versions: DataFrame, findings: DataFrame, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of all runs, joined to each version that holds the blob: (key, blob, kinds, starts, ends); empty arrays where there are none.

    Where several runs scanned a blob, their findings are put together in order, each once. A plain join on the blob:
    Spark splits the rows of a blob with very many versions over tasks.
    """
    held = versions.select(F.col(key), blob_id(F.col(text_col)).alias("blob"))
    at = F.arrays_zip("starts", "ends", "kinds")
    order = [r.kind for r in RULES]
    place = F.transform(at, lambda x: F.struct(x["starts"].alias("starts"), F.array_position(F.array(*map(F.lit, order)), x["kinds"]).alias("place"), x["ends"].alias("ends"), x["kinds"].alias("kinds")))
    merged = findings.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(place)))).alias("x"))
    findings = merged.select("blob", *(F.col(f"x.{c}").alias(c) for c in ("kinds", "starts", "ends")))
    fill = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return held.join(findings, "blob", "left").select(key, "blob", fill("kinds", "string"), fill("starts", "long"), fill("ends", "long"))


def digests(findings: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base findings and the list of all findings, for each row of scan_blobs()."""
    at = F.arrays_zip("kinds", "starts", "ends")
    spell = lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    base = F.filter(at, lambda x: x["kinds"].isin(*BASE))
    return findings.select(*(c for c in findings.columns if c not in ("kinds", "starts", "ends")), *(count(k) for k in BASE), F.sha2(F.concat_ws(",", F.transform(base, spell)).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.transform(at, spell)).alias("spans"))


class Ledger:
    """The runs so far, in a folder that all executors share; each run is a table of its own in it, one row a blob it scanned.

    A run counts once its job has been committed, so one that broke off leaves nothing, and the next run scans its blobs. Two runs at once
    may scan a blob twice; its findings are given once. Findings of older rule versions stay on record and are left out where
    findings are asked for.
    """

    SCHEMA = "blob string, versions map<string,int>, kinds array<string>, starts array<long>, ends array<long>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        within = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + "/run-*/_SUCCESS")
        done = sorted(x.getPath().getParent().toString() for x in fs.globStatus(within) or [])
        return self.spark.read.schema(self.SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], self.SCHEMA)

    def scanned(self) -> DataFrame:
        """The ledger proper: (blob, kind, version), each once or more."""
        return self._runs().select("blob", F.explode("versions").alias("kind", "version"))

    def findings(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """(blob, kinds, starts, ends) of all runs, without what versions other than those of rules found."""
        current = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
        at = F.filter(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.col("versions")[x["kinds"]] == current[x["kinds"]])
        return self._runs().select("blob", at.alias("x")).select("blob", *(F.col(f"x.{c}").alias(c) for c in ("kinds", "starts", "ends")))

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text") -> DataFrame:
        """One run: scan the blobs of versions for the rule versions that the ledger lacks, and take both down. Returns the rows taken down."""
        found = scan_blobs(unseen_blobs(versions, self.scanned(), rules, text_col=text_col), rules)
        current = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
        taken = F.map_from_arrays("todo", F.transform("todo", lambda k: current[k])).alias("versions")
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        found.select("blob", taken, "kinds", "starts", "ends").write.parquet(path)
        return self.spark.read.schema(self.SCHEMA).parquet(path)

    def by_path(self, versions: DataFrame, rules: Sequence[Rule] = RULES, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        """findings_by_path() of all runs."""
        return findings_by_path(versions, self.findings(rules), key=key, text_col=text_col)


#: Setting that names the folder of a lasting ledger.
LEDGER = "spark.helixframe.secrets.ledger"


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document after two runs: the second one scans only blobs that the ledger of the first one lacks. Null texts are empty; repeated rows are rows of their own.

    The ledger is the folder that the setting LEDGER names; what earlier calls scanned is not scanned again. Without that setting it
    is a new folder in the shared one, so that a call does all of its work.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    second = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1, F.lit(False))
    ledger = Ledger(spark, spark.conf.get(LEDGER, None) or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    ledger.scan(docs.where(~second))
    ledger.scan(docs.where(second))
    return digests(ledger.by_path(docs)).drop("blob")


NOTHING = hashlib.sha256(b"").hexdigest()
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), r(kind, place, pat, least) AS (VALUES
  ('assign', 0, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+', 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 18), ('hex', 2, '[0-9a-f]+', 16), ('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,. \t\r\n-]*?-----END [A-Z ]*PRIVATE KEY-----)?', 1)
), m AS (
  SELECT doc_id, kind, place, least,
    CASE place WHEN 0 THEN regexp_extract_all(t, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+')
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_extract_all(t, '[0-9a-f]+') ELSE regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,. \t\r\n-]*?-----END [A-Z ]*PRIVATE KEY-----)?') END AS hits,
    CASE place WHEN 0 THEN regexp_split_to_array(t, '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+')
      WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_split_to_array(t, '[0-9a-f]+') ELSE regexp_split_to_array(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,. \t\r\n-]*?-----END [A-Z ]*PRIVATE KEY-----)?') END AS gaps
  FROM d, r
), x AS (
  SELECT doc_id, kind, place, least, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(generate_series(1, len(hits))) AS i FROM m WHERE len(hits) > 0
), y AS (
  SELECT *, CAST(sum(length(hit) + length(gap)) OVER (PARTITION BY doc_id, place ORDER BY i) AS BIGINT) AS e FROM x
), z AS (
  SELECT doc_id, kind, place, e - length(hit) AS s, e FROM y
  WHERE CASE place WHEN 0 THEN length(regexp_extract(hit, '^(?:[A-Za-z_]+)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) ELSE length(hit) END >= least
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM z GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
