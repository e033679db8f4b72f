"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). A ledger table holds, for
each blob, the rules (name and version) it was scanned with and what they found; only blobs with a
rule version that the ledger lacks are scanned, once however many paths hold them, and findings are
joined back to all paths. A changed rule gets a new version and is the only one run again. The
ledger is the folder that a caller or the session's setting (``SETTING``) names, so that a later scan
of the same corpus finds its blobs known; where neither does, a new one in the shared folder, so that
all is scanned. What a stopped scan left without its mark of success is not read.

Rows: null text is the empty blob; empty texts have no findings; repeated rows are returned each
time; null ids are paths like any other. Texts are scanned whole and findings have no greatest
length: a secret is found, and redacted, to its end. No rows give no rows.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, work_dir
from .spans import joined, with_spans


class Rule(NamedTuple):
    """Matches of ``pattern`` are findings if they have ``least`` characters; texts without ``clue`` (regular expression) have none."""

    name: str
    version: int
    pattern: str
    least: int
    clue: str


_WORD = r"(?i:password|passwd|secret|token|api_?key)"
_BODY = r"[A-Za-z0-9+/_.=-]"
_LABEL = r"(?:[A-Z0-9]++\x20){0,4}?PRIVATE KEY(?: BLOCK)?"
#: The three base rules, then well-known public token formats.
RULES = [
    Rule("assign", 1, rf"{_WORD}[\"']?\x20*[:=]\x20*[\"']?{_BODY}+", 0, _WORD),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}+", 32, ""),
    # a key without its end line reaches to the first character that no key's body has
    Rule("pem", 2, rf"-----BEGIN {_LABEL}-----(?:(?:\s++Proc-Type:\x20[0-9A-Z,]++\s++DEK-Info:\x20[A-Z0-9-]++,[0-9A-Fa-f]++)?+[^-]*+-----END {_LABEL}-----|[A-Za-z0-9+/=\s]*+)", 0, "-----BEGIN"),
    Rule("github", 2, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", 0, "gh[pousr]_"),
    Rule("slack", 2, r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+", 0, "xox[abprs]-"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, "eyJ"),
    Rule("urlpass", 2, r"://[A-Za-z0-9._~%-]*+:[A-Za-z0-9._~%!$&*+=-]{3,}+@[A-Za-z0-9.-]++", 0, "://"),
]
BASE = ["assign", "access", "hex"]
#: Blobs and findings (under 100 bytes each) up to which they are broadcast to texts; beyond, the join is shuffled.
BROADCAST_FINDINGS = 500_000
FINDINGS = "array<struct<rule:string,start:int,end:int>>"
#: Session setting that names the folder of a kept ledger.
SETTING = "tarnrank.secret.ledger"
#: Code points in a block that a text is cut into before pieces are taken out of it.
BLOCK = 4096


def _key(rule: Rule) -> str:
    return f"{rule.name}@{rule.version}"


def scan(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """blob, text, todo (rule keys) to blob, rules, findings; each text is read in its row."""
    df = blobs
    for rule in rules:
        due = F.array_contains("todo", _key(rule))
        df = with_spans(df, "text", f"f_{rule.name}", rule.pattern, due & F.col("text").rlike(rule.clue) if rule.clue else due)

    def kept(rule: Rule) -> Column:
        spans = F.col(f"f_{rule.name}")
        if rule.name == "assign":
            # the value is what follows the sign and an optional quote
            group = lambda s: F.length(F.regexp_extract(s["value"], rf"^{_WORD}[\"']?\x20*[:=]\x20*[\"']?({_BODY}+)$", 1))
            spans = F.filter(spans, lambda s: group(s) >= 8)
        elif rule.least:
            spans = F.filter(spans, lambda s: s["end"] - s["start"] >= rule.least)
        return F.transform(spans, lambda s: F.struct(F.lit(rule.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))

    return df.select("blob", F.col("todo").alias("rules"), F.concat(*map(kept, rules)).cast(FINDINGS).alias("findings"))


def findings(versions: DataFrame, text_col: str = "text", ledger: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """The columns of ``versions`` but the text, with ``blob`` and ``findings`` (rule, start, end); its own of those names go.

    ledger: folder of the ledger; if None that of ``SETTING``, if unset a new one. What is scanned is
    added to it as a batch of Parquet. Only hashes are compared with it: a text is shuffled once, pre-aggregated by hash.
    """
    rules = RULES if rules is None else rules
    spark, keys = versions.sparkSession, [_key(r) for r in rules]
    ledger = ledger or spark.conf.get(SETTING, None) or f"{work_dir(spark)}/secrets-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in versions.columns if c not in (text_col, "blob", "findings")]
    paths = versions.select(*kept, F.sha2(text, 256).alias("blob"))
    due = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known, every = _read(spark, ledger), F.array(*map(F.lit, keys))
    if known is None:
        due = due.withColumn("todo", every)
    else:
        known = known.join(paths.select("blob").distinct(), "blob", "left_semi")
        # settled on the ledger's side of the join, so that the plan of the scan holds it once
        rest = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.array_except(every, F.collect_set("rule")).alias("rest"))
        due = due.join(rest, "blob", "left").withColumn("todo", F.coalesce("rest", every))
        due = due.where(F.size("todo") > 0)
    new = materialize(scan(due.select("blob", "text", "todo"), rules), f"{ledger}/batch-{uuid.uuid4().hex}")
    found = new.select("blob", "findings")
    if known is not None:
        # findings of rule versions in force: older versions' findings stay in the ledger only
        both = known.union(new).select("blob", F.explode("rules").alias("key"), "findings").where(F.col("key").isin(keys))
        rows = both.select("blob", F.filter("findings", lambda f: f["rule"] == F.substring_index("key", "@", 1)).alias("findings"))
        found = materialize(rows.groupBy("blob").agg(F.flatten(F.collect_set("findings")).alias("findings")))
    return paths.join(found, "blob").select(*kept, "blob", "findings")


def _read(spark, ledger: str) -> DataFrame | None:
    """The whole batches of a ledger, or None where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(ledger)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = files.globStatus(hadoop.Path(path, "batch-*/_SUCCESS")) if files.exists(path) else []
    whole = sorted(m.getPath().getParent().toString() for m in marks)
    return spark.read.schema(f"blob string, rules array<string>, findings {FINDINGS}").parquet(*whole) if whole else None


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (with a column text) with every finding replaced by ``mark``; no row goes.

    Overlapping findings are replaced together. Texts are shuffled only where findings are too many
    to be broadcast, which is counted. A text's work grows with its length and its findings, as
    pieces are taken from blocks of it.
    """
    found = findings(docs.select("text"), "text", ledger).where(F.size("findings") > 0).distinct()
    spans = found.select("blob", F.explode("findings").alias("f")).select("blob", F.col("f.start").alias("start"), F.col("f.end").alias("end")).distinct()
    # each piece starts where all spans before it have ended; a span inside those adds nothing
    earlier = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    own = F.collect_list(F.when(F.col("start") >= F.col("reach"), F.struct("start", "reach")))
    found = materialize(spans.groupBy("blob").agg(F.sort_array(own).alias("__spans"), F.max("end").alias("__last")).withColumnRenamed("blob", "__blob"))
    n = found.agg(F.count("*") + F.sum(F.size("__spans"))).first()[0] or 0
    found = F.broadcast(found) if n <= BROADCAST_FINDINGS else found
    rows = docs.withColumn("__blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, "__blob", "left")
    blocks = F.when(F.size("__spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    rows = rows.withColumn("__blocks", blocks)

    def piece(low: Column, high: Column) -> Column:
        first = F.floor(low / BLOCK).cast("int")
        held = F.array_join(F.slice("__blocks", first + 1, F.floor((high - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(high > low, F.substring(held, low - first * BLOCK + 1, high - low)).otherwise(F.lit(""))

    parts = F.array_join(F.transform("__spans", lambda s: F.concat(piece(s["reach"], s["start"]), F.lit(mark))), "")
    whole = F.concat(parts, piece(F.col("__last"), F.length("text")))
    return rows.withColumn("text", F.when(F.size("__spans") > 0, whole).otherwise(F.col("text"))).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id and findings to the columns of the report."""
    names = [r.name for r in RULES]
    spans = lambda only: F.transform(F.filter("findings", lambda f: f["rule"].isin(only)), lambda f: F.struct(f["rule"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
    count = lambda name: F.size(F.filter("findings", lambda f: f["rule"] == name)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(spans(BASE), BASE), 256).alias("base_sha256"), joined(spans(names), names).alias("spans")
    )
