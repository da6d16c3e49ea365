"""Secret scans with an incremental ledger of blobs.

A blob is a text, named by its SHA-256; every document is a path to a blob, as
every historical version of a file is.  The ledger says which rule versions have
already seen which blob.  A scan takes one text of each blob for which some rule
version is not in the ledger, looks for those rules only, and adds its findings
and pairs to the ledger; findings are then joined back to all paths.  Changing a
rule means a new version of it, which scans every blob once more for that rule.

Everything is column expressions and joins.  The representative of a blob is found
by an aggregate over names only; texts are joined to it by blob and path, so that
many copies of a blob spread over the partitions.  Places of findings come from
the lengths of the matches and of the pieces between them, summed over a window
per blob and rule.

Defined results: a private key counts from its first line through its last one (with up
to eight hyphens in headers between), and where there is no last line through the lines
of 16 and more key characters behind the first; a null text is the empty blob; it has no findings; a path that
occurs several times, also with the same text, is reported each time; null paths
are paths like others; an empty table or ledger is allowed.  The input's columns
are picked by name, others are not read, so they cannot clash.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estilens.llm.common import let, staged


class Rule(NamedTuple):
    """What to search, and what a match must have to be a finding."""

    kind: str
    version: int
    pattern: str
    #: Matches shorter than this are passed over, after they have been searched through.
    least: int = 1
    #: A pattern for what stands before the value; the value is what least counts.
    before: str = ""


#: Kinds are reported in this order where several begin at one place.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6,
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, "[0-9a-f]{24,}"),  # the same as runs of any length, of which shorter ones are dropped
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    # A whole key; where its last line is missing, the head and the lines of key material behind it.
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----|\r?\n[A-Za-z0-9+/=\r\n]{16,}|)"),
    Rule("forge", 1, "gh[oprsu]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
#: Findings up to this number are sent to all executors (about 100 bytes each).
SENT_SPANS = 200_000


def rule_name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def addressed(docs: DataFrame) -> DataFrame:
    """(path, blob) of every document."""
    return docs.select(F.col("doc_id").alias("path"), blob_name(F.col("text")).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, path, rules): one path for each blob, and the rule versions that have not seen it."""
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.lit(rule_name(rule)) for rule in rules])
    if ledger is None:
        return blobs.withColumn("rules", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # at most one entry per rule version
    missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "path", missing.alias("rules")).filter(F.size("rules") > 0)


def _matches(rule: Rule, text: Column) -> Column:
    """Matches of a rule and the pieces between them, or null if there are none."""
    wanted = F.array_contains("rules", rule_name(rule)) & text.rlike(rule.pattern)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return F.when(wanted, F.struct(
        F.lit(rule_name(rule)).alias("rule"), F.lit(rule.least).alias("least"), F.lit(rule.before).alias("before"),
        F.arrays_zip(found.alias("match"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("piece")).alias("hits"),
    ))


def scan(docs: DataFrame, todo: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, begin, end): findings of unseen pairs, in code points, end exclusive."""
    texts = docs.select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_name(F.col("text")))
    todo = todo.withColumnRenamed("blob", "todo_blob").withColumnRenamed("path", "todo_path").hint("shuffle_hash")
    texts = texts.join(todo, (F.col("blob") == F.col("todo_blob")) & F.col("path").eqNullSafe(F.col("todo_path")))
    per_rule = F.filter(F.array(*[_matches(rule, F.col("text")) for rule in rules]), lambda x: x.isNotNull())
    hits = texts.select("blob", F.explode(per_rule).alias("r")).select(
        "blob", "r.rule", "r.least", "r.before", F.posexplode("r.hits").alias("k", "hit")
    )
    # Equal rows of one path were scanned alike: one of each is enough.
    hits = hits.dropDuplicates(["blob", "rule", "k"])
    size = F.length("hit.match")
    ends = F.sum(size + F.length("hit.piece")).over(
        Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # The longest beginning that fits is the one the match had; what follows is its value.
    value = F.when(F.col("before") == "", size).otherwise(reduce(
        lambda rest, rule: F.when(F.col("rule") == rule_name(rule), F.length(F.regexp_replace("hit.match", f"^{rule.before}", ""))).otherwise(rest),
        [rule for rule in rules if rule.before], size,
    ))
    return hits.select("blob", "rule", (ends - size).alias("begin"), ends.alias("end"), (value >= F.col("least")).alias("ok")).filter("ok").drop("ok")


def summary(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob its findings (begin, order of kind, end, kind), sorted."""
    order = F.lit(None).cast("int")
    for k, rule in enumerate(rules):
        order = F.when(F.col("rule") == rule_name(rule), k).otherwise(order)
    finding = F.struct("begin", order.alias("kind_order"), "end", F.split_part("rule", F.lit("@"), F.lit(1)).alias("kind"))
    # As long as one text's findings, never longer than the text.
    return findings.groupBy("blob").agg(F.sort_array(F.collect_list(finding)).alias("found"))


class History(NamedTuple):
    paths: DataFrame
    findings: DataFrame
    ledger: DataFrame


def scan_history(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> History:
    """Scan what the ledger lacks; the results are written tables, with the former ones included.

    Findings of rule versions that are no longer in rules stay in the ledger's
    tables but are left out by found_in.
    """
    paths = staged(addressed(docs), "secret-paths")
    todo = staged(unseen(paths, ledger, rules), "secret-todo")
    new = staged(scan(docs, todo, rules), "secret-findings")
    pairs = todo.select("blob", F.explode("rules").alias("rule"))
    return History(paths, new if findings is None else findings.unionByName(new), pairs if ledger is None else ledger.unionByName(pairs))


def found_in(history: History, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found): the findings of every path."""
    current = history.findings.filter(F.col("rule").isin([rule_name(rule) for rule in rules]))
    return history.paths.join(summary(current, rules), "blob", "left")


def _spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    found = F.coalesce("found", F.array().cast("array<struct<begin:bigint,kind_order:int,end:bigint,kind:string>>"))
    rows = found_in(scan_history(docs)).select(F.col("path").alias("doc_id"), found.alias("found"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(list(BASE)))
    return rows.select("doc_id", *[count(kind) for kind in BASE], F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All documents with a mark in place of every finding; all columns as given.

    Findings that overlap or touch get one mark; n_chars, if there, follows the new text.
    """
    found = staged(summary(scan_history(docs).findings).select("blob", F.col("found").alias("spans")), "secret-spans")
    # Texts need not move while the findings are few; more of them meet the texts in a shuffle.
    if (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= SENT_SPANS:
        found = F.broadcast(found)
    rows = docs.select(F.struct("*").alias("row"), blob_name(F.col("text")).alias("blob")).join(found, "blob", "left")
    span = "struct<begin:bigint,end:bigint>"

    def add(merged, x):
        last = F.get(merged, F.size(merged) - 1)
        wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end")).cast(span)
        return F.when(x["begin"] <= last["end"], F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(wider))).otherwise(
            F.concat(merged, F.array(F.struct(x["begin"], x["end"]).cast(span)))
        )

    def marked(spans):
        def piece(k):
            begin = F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
            return F.substring("row.text", (begin + 1).cast("int"), (F.coalesce(F.get(spans, k)["begin"], F.length("row.text")) - begin).cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), mark)

    clean = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(
        let(F.aggregate("spans", F.array().cast(f"array<{span}>"), add), marked)
    )
    # Through an array, so that the text is put together once for both columns.
    rows = rows.select("row", F.col("spans").isNull().alias("same"), F.explode(F.array(clean)).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return rows.select(*[
        (F.when(F.col("same"), F.col("row")[c]).otherwise(new[c].cast(docs.schema[c].dataType)) if c in new else F.col("row")[c]).alias(c)
        for c in docs.columns
    ])
