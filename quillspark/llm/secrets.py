"""Secret scanning over an incremental blob ledger (operator 8, native).

Every version of every document is a blob, named by the SHA-256 of its text. The ledger says which
(blob, rule version) pairs have been scanned and what was found; a scan takes only blobs the ledger
does not hold for the current rules, each once however many documents share it, and the findings
are joined back to every path (document) that ever held the blob.

The rule version is a digest of the rules, so changed rules are scanned anew.

Spans come from JVM regular expressions: each match is wrapped in private marks, the marked text is
split, and lengths add up to code-point positions. Only digests are grouped: of a blob that several rows
hold, the row of the smallest id is scanned, and texts are filtered where they are. The few key tables
that this and the join back need are broadcast behind a count, else those joins are salted.

Nulls and odd cases: a null text is an empty one; null ids are kept; repeated rows each get the
findings; spans that overlap, of one rule or several, are all reported, by start and then rule; a long
text is scanned whole, in time proportional to it; an empty table gives an empty result; other columns are
ignored; the marks' own characters in a text are read as another control character, which no rule can match.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, packed, salt, spread, table

BASE_KINDS = ("assign", "access", "hex")
OPEN, SPLIT, CLOSE = "\x01", "\x02", "\x03"
SALTS = 8
BROADCAST_SPANS = 200_000
BROADCAST_BLOBS = 1_000_000  # of a digest and an id


@dataclass(frozen=True)
class Rule:
    """``pattern`` has two groups, what leads in and the secret itself; a match with a secret shorter
    than ``least`` characters is dropped. ``hint`` must occur in the lower-cased text if given."""

    kind: str
    pattern: str
    least: int = 1
    hint: str | None = None


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"()(AKIA[A-Z0-9]+)", 20, "AKIA"),
    Rule("hex", r"()((?<![0-9a-f])[0-9a-f]{24,})", 24),
    Rule("github", r"()(gh[pousr]_[A-Za-z0-9]{36,})", 40, "gh"),
    Rule("slack", r"()(xox[baprs]-[A-Za-z0-9-]{10,})", 15, "xox"),
    Rule("jwt", r"()(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 24, "eyJ"),
    Rule("pem", r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z ]*PRIVATE KEY-----)?)", 1, "PRIVATE KEY-----"),
)
FINDINGS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def version_of(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """array<(start, rank, kind, end)> of one rule's matches in a text without marks."""
    marked = F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{OPEN}$1{SPLIT}$2{CLOSE}"))
    pieces = F.split(marked, OPEN)

    def one(acc: Column, piece: Column) -> Column:
        lead = F.locate(SPLIT, piece) - 1
        secret = F.locate(CLOSE, piece) - F.locate(SPLIT, piece) - 1
        start = acc["at"]
        end = start + lead + secret
        row = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(
            (start + F.length(piece) - 2).alias("at"),
            F.when(secret >= rule.least, F.concat(acc["found"], F.array(row))).otherwise(acc["found"]).alias("found"),
        )

    begin = F.struct(F.length(pieces[0]).cast("long").alias("at"), F.array().cast(FINDINGS).alias("found"))
    found = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), begin, one, lambda acc: acc["found"])
    here = text.rlike(rule.pattern)
    return F.when((text.contains(rule.hint) & here) if rule.hint else here, found).otherwise(F.array().cast(FINDINGS))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, findings)`` of ``blobs(blob, text)``, for blobs that have findings; by start, then rule."""
    plain = blobs.withColumn("text", F.translate("text", OPEN + SPLIT + CLOSE, "\x04\x04\x04"))
    for rank, rule in enumerate(rules):
        plain = plain.withColumn(f"_{rank}", _spans(F.col("text"), rank, rule))
    return plain.select("blob", F.array_sort(F.concat(*(f"_{i}" for i in range(len(rules))))).alias("findings")).where("size(findings) > 0")


class Ledger:
    """A folder of Parquet tables: ``scanned(blob, rule_version)`` and ``findings(blob, rule_version, findings)``.

    Findings are written first: a run that breaks off between the two writes repeats its scan, and
    repeated findings of a blob are equal and collapse when read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        if self._has(name):
            return self.spark.read.schema(schema.replace(";", ",")).parquet(f"{self.folder}/{name}")
        return self.spark.range(0).select(*(F.lit(None).cast(kind).alias(column) for column, kind in (x.split(" ", 1) for x in schema.split("; "))))

    def _has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string; rule_version string")

    def findings(self, rule_version: str) -> DataFrame:
        found = self._read("findings", f"blob string; rule_version string; findings {FINDINGS}")
        return found.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.max("findings").alias("findings"))

    def extend(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES, *, broadcast_blobs: int = BROADCAST_BLOBS) -> int:
        """Scans what of ``texts(blob, path, text)`` is not yet scanned by these rules, each blob once; returns how many blobs."""
        version, again = version_of(rules), self._has("scanned")
        firsts = texts.groupBy("blob").agg(F.min("path").alias("_first"), F.count("*").alias("_n"))
        if again:
            firsts = firsts.join(self.scanned().where(F.col("rule_version") == version).select("blob").distinct(), "blob", "left_anti")
        unseen = cut(firsts, "blobs")
        # all that is unseen in a first scan: only blobs of several rows need a choice
        wanted = unseen if again else unseen.where("_n > 1")
        how = "inner" if again else "left"
        if wanted.count() <= broadcast_blobs:
            joined = texts.join(F.broadcast(wanted), "blob", how)
        else:
            joined = salt(texts, F.col("path"), SALTS).join(spread(wanted, SALTS), ["blob", "_salt"], how)
        chosen = joined.where(F.col("_n").isNull() | F.col("path").eqNullSafe(F.col("_first"))).select("blob", "text")
        scan(chosen, rules).withColumn("rule_version", F.lit(version)).select("blob", "rule_version", "findings").write.mode("append").parquet(f"{self.folder}/findings")
        unseen.select("blob", F.lit(version).alias("rule_version")).write.mode("append").parquet(f"{self.folder}/scanned")
        return unseen.count()


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(blob, path, text)``: what the ledger is extended by; the path is the row's id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(blob_of(text).alias("blob"), F.col(id_col).cast("string").alias("path"), text.alias("text"))


def with_findings(docs: DataFrame, ledger: Ledger, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(_row, text, findings)`` for every row of ``docs``, after extending the ledger by their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ledger.extend(versions(docs, id_col, text_col), rules)
    found = cut(ledger.findings(version_of(rules)).select("blob", "findings"), "findings")
    paths = packed(docs, text=text, blob=blob_of(text))
    spans = found.agg(F.coalesce(F.sum(F.size("findings")), F.lit(0))).first()[0]
    if spans <= BROADCAST_SPANS:  # a row has a span at least, and a digest and spans have a fixed width
        joined = paths.join(F.broadcast(found), "blob", "left")
    else:
        salted = paths.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread(found, SALTS), ["blob", "_salt"], "left")
    return joined.select("_row", "text", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def spans_string(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, findings: Column) -> Column:
    """The text with each finding replaced by ``[SECRET]``; where findings overlap the first one counts."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
        F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("[SECRET]")).alias("out"))
    )
    clean = F.aggregate(findings, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(findings) > 0, clean).otherwise(text)


def without_secrets(docs: DataFrame, ledger: Ledger, *, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with every finding in the text replaced; ``length_col`` follows the new text."""
    found = with_findings(docs, ledger, text_col=text_col, **options)
    found = found.select("_row", F.size("findings") > 0, redact(F.col("text"), F.col("findings"))).toDF("_row", "changed", "clean")
    changed, clean = F.col("changed"), F.col("clean")
    new = {text_col: F.when(changed, clean).otherwise(F.col(f"_row.`{text_col}`"))}
    if length_col in docs.columns:
        new[length_col] = F.when(changed, F.length(clean).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"_row.`{length_col}`"))
    return found.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op8_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """The table is put in the ledger twice: what the second scan finds is already known, and nothing is scanned again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    ledger.extend(versions(docs, "doc_id", "text"))
    found = with_findings(docs, ledger).select("_row.doc_id", "findings")
    base = F.filter("findings", lambda x: x["rank"] < len(BASE_KINDS))
    of_kind = lambda kind: F.filter("findings", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_string(base).cast("binary"), 256).alias("base_sha256"), spans_string(F.col("findings")).alias("spans"))
