"""Secret scans with an incremental ledger of blobs.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger, a table in
the shared folder, has one row for each blob and rule version that was scanned, with the places
found. A call scans only blobs with unseen pairs of blob and rule version, adds them to the ledger
and joins the ledger's findings back to all paths. Each scan task sends a blob once however often it
has it, so a blob with a third of all rows does no harm. All work is column expressions.

Rules for odd input: a null text is the empty text; null paths are kept and get their findings;
repeated rows each get theirs. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, shared_folder
from .spans import SPANS, match_spans


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    hint: str  # a text without it has no match; a pattern itself
    group: int = 0
    least: int = 0


# The three base kinds. Runs that are too short can be left out by the pattern itself
# for access and hex, because a run that fails holds no other match; for assign a failing match
# uses up its text, so its length is tested afterwards.
RULES = (
    Rule(
        "assign", 1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i)(?:word|passwd|secret|token|key)["']?\x20*[:=]""", 2, 6,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", 1, "(?<![0-9a-f])[0-9a-f]{24,}", "[0-9a-f]{24}"),
    # The method's own kinds.
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN"),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b", "gh[pousr]_"),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,200}", "xox[abprs]-"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("google", 1, r"\bAIza[A-Za-z0-9_-]{35}", "AIza"),
    Rule("url_login", 1, r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", "://"),
)
BASE_KINDS = ("assign", "access", "hex")


def _scan(text: Column, rule: Rule) -> Column:
    found = match_spans(text, F.lit(rule.pattern), rule.group, rule.least)
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(SPANS))


class BlobLedger:
    """Scanned pairs of blob and rule version, in Parquet files under ``path``.

    A pair is written in one row with its findings; a failed write leaves no row and is done again,
    and a pair that was written twice is read once.
    """

    SCHEMA = f"blob string, kind string, version int, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All ledger rows; an empty ledger has none."""
        empty = self.spark.createDataFrame([], self.SCHEMA)
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/pairs")
        except Exception as e:  # noqa: BLE001 - only a missing table means an empty ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return empty

    def add(self, texts: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Scan what is new in ``texts`` (blob, text: rows of one blob are equal)."""
        wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
        nothing = F.array().cast("array<struct<kind:string,version:int>>")
        seen = self.rows().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
        todo = (
            blobs.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(wanted, F.coalesce("seen", nothing)))
            .where(F.size("todo") > 0)
        )
        text = F.col("text")
        results = [
            F.when(
                F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
                F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _scan(text, r).alias("spans")),
            )
            for r in rules
        ]
        found = todo.select("blob", F.explode(F.array_compact(F.array(*results))).alias("r"))
        found.select("blob", "r.kind", "r.version", "r.spans").write.mode("append").parquet(f"{self.path}/pairs")

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """Per blob with findings: map-like array of (order of the kind, kind, s, e), by start, then kind as listed."""
        order = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
        place = F.array_position(order, F.struct("kind", "version")).cast("int")
        rows = self.rows().where(F.size("spans") > 0).withColumn("place", place).where("place > 0")
        spans = rows.select("blob", "place", "kind", F.explode("spans").alias("x")).select(
            "blob", F.struct(F.col("x.s").alias("s"), "place", F.col("x.e").alias("e"), "kind").alias("span")
        )
        return spans.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def scan_versions(
    versions: DataFrame, ledger: BlobLedger | None = None, path_col: str = "doc_id", text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per version: path, blob, spans (array of start, place, end, kind)."""
    versions = only(versions, path=path_col, text=text_col)
    ledger = ledger or BlobLedger(versions.sparkSession, shared_folder(versions.sparkSession))
    text = F.coalesce("text", F.lit(""))
    texts = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    ledger.add(texts, rules)
    paths = versions.select("path", F.sha2(text, 256).alias("blob"))
    none = F.array().cast("array<struct<s:bigint,place:int,e:bigint,kind:string>>")
    return paths.join(ledger.findings(rules), "blob", "left").select(
        "path", "blob", F.coalesce("spans", none).alias("spans")
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )
