"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) with their tokens. The cells' weights are
raked: scaled to the target share of each source, then of each language, then of each topic, again
and again, so that all three marginals meet their targets. A document's multiplier is its cell's
weight over its cell's share of tokens; a document is taken ``copies`` times, floor(expected) plus
one more with the probability of the rest, decided by a hash of its id. Only cells, never documents,
go through the rounds; a round's result is written to the shared folder, so plans stay short. Rounds
go on until no marginal is further than ``TOLERANCE`` from its target. Targets that the cells cannot
meet at all end it too, at ``LIMIT`` rounds or when STALL looks bring nothing; the gap left is then
given in a warning. All work is column expressions and SQL aggregates.

Targets are shares by value. Without given targets each dimension's token shares are tempered:
share^power, normalised. A value without a target keeps weight 0; a target value without tokens is
left out and the others share its weight.

Rules for odd input: null is a value of its own in every dimension; null or wordless texts have no
tokens, a multiplier as their cell's, and multiplier 0 in a cell without any tokens. Rows that
repeat an id get the same decision. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS = ("source", "language", "topic")
ROUNDS = 6  # done before marginals are looked at; also those of the oracle
TOLERANCE = 1e-6  # largest difference of a marginal from its target
LIMIT = 1000  # rounds
EVERY = 4  # rounds from one look at the marginals to the next
STALL = 5  # looks without a hundredth less difference
POWER = 0.7
KEEP = 0.9  # expected tokens of the sample, as a share of all tokens
SEED = "mix-1"
HASH_SPACE = 2**48


def topic_of(text: Column) -> Column:
    """A document's topic by plain signs in its text; the first that holds."""
    return (
        F.when(text.isNull() | (F.length(text) == 0), "empty")
        .when(text.contains(" | "), "tables")
        .when(text.contains("license") | text.contains("License"), "licensing")
        .when(text.contains("!! "), "shouting")
        .when(text.contains("***") | text.contains("$$$") | text.contains("%%%"), "symbols")
        .when(F.length(text) >= 8000, "long prose")
        .when(F.length(text) >= 1500, "prose")
        .otherwise("short prose")
    )


def token_count(text: Column) -> Column:
    """Words between white space."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", -1)
    ends = (pieces[0] == "").cast("int") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return (F.size(pieces) - ends).cast("bigint")


def _named(value: Column) -> Column:
    """Text for a value, with null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, target): shares of tokens to the power, normalised."""
    sums = cells.where("tokens > 0").groupBy(F.col(dimension).alias("value")).agg(
        F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("part")
    )
    total = sums.agg(F.sum("part")).first()[0]
    return sums.select("value", (F.col("part") / F.lit(total or 1.0)).alias("target"))


def given_targets(spark: SparkSession, cells: DataFrame, dimension: str, shares: dict) -> DataFrame:
    rows = [("" if k is None else f"={k}", float(v)) for k, v in shares.items() if v > 0]
    wanted = spark.createDataFrame(rows, "value string, target double")
    there = cells.where("tokens > 0").select(F.col(dimension).alias("value")).distinct()
    wanted = wanted.join(there, "value", "left_semi")
    total = wanted.agg(F.sum("target")).first()[0]
    return wanted.select("value", (F.col("target") / F.lit(total or 1.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = LIMIT, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with ``weight`` fitted to the targets of every dimension, in ``rounds`` rounds at most; weights sum to 1."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for name in DIMENSIONS:  # targets stand beside the cells from the start
        wanted = targets[name].select(F.col("value").alias(name), F.col("target").alias(f"target_{name}"))
        fitted = fitted.join(wanted, name, "left")
    fitted = stored(fitted)
    gaps: list[float] = []
    for done in range(1, rounds + 1):
        for name in DIMENSIONS:
            have = F.sum("weight").over(Window.partitionBy(name))
            scale = F.when(F.col("have") > 0, F.coalesce(f"target_{name}", F.lit(0.0)) / F.col("have")).otherwise(0.0)
            fitted = fitted.withColumn("have", have).withColumn("weight", F.col("weight") * scale).drop("have")
        fitted = stored(fitted)  # one small job a round, over cells only
        if done != rounds and (done < ROUNDS or (done - ROUNDS) % EVERY):
            continue
        gaps.append(deviation(fitted))
        if gaps[-1] <= tolerance:
            break
        if done == rounds or (len(gaps) > STALL and gaps[-1] > 0.99 * gaps[-1 - STALL]):
            warnings.warn(f"after {done} rounds a marginal is {gaps[-1]:.3g} from its target", stacklevel=3)
            break
    return fitted


def deviation(fitted: DataFrame) -> float:
    """Largest difference of a marginal from its target, over all dimensions in one pass."""
    each = F.array(
        *(
            F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.coalesce(f"target_{d}", F.lit(0.0)).alias("target"))
            for d in DIMENSIONS
        )
    )
    sums = fitted.select(F.explode(each).alias("m"), "weight").groupBy("m").agg(F.sum("weight").alias("have"))
    return sums.agg(F.max(F.abs(F.col("have") - F.col("m.target")))).first()[0] or 0.0


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    language_col: str = "lang", topic: Column | None = None, targets: dict[str, dict] | None = None,
    power: float = POWER, keep: float = KEEP, rounds: int = LIMIT, seed: str = SEED, also: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: id, source, language, topic, tokens, multiplier, expected, copies.

    ``also`` are further columns made from ``docs`` that go with the rows, to tell rows of one id apart.
    """
    also = also or {}
    text = docs[f"`{text_col}`"]
    rows = stored(
        docs.select(
            docs[f"`{id_col}`"].alias("id"), _named(docs[f"`{source_col}`"]).alias("source"),
            _named(docs[f"`{language_col}`"]).alias("language"),
            _named(topic if topic is not None else topic_of(text)).alias("topic"), token_count(text).alias("tokens"),
            *(c.alias(name) for name, c in also.items()),
        )
    )
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    wanted = {
        d: stored(
            given_targets(docs.sparkSession, cells, d, targets[d]) if targets and d in targets
            else tempered_targets(cells, d, power)
        )
        for d in DIMENSIONS
    }
    fitted = rake(cells, wanted, rounds)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(total or 1))
    multipliers = fitted.select(
        *DIMENSIONS, F.when(F.col("tokens") > 0, F.col("weight") / share).otherwise(0.0).alias("multiplier")
    )
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(HASH_SPACE))
    expected = F.col("multiplier") * F.lit(keep)
    out = rows.join(multipliers, list(DIMENSIONS)).select(
        "id", *(F.when(F.col(d) != "", F.substr(F.col(d), F.lit(2))).alias(d) for d in DIMENSIONS),
        "tokens", "multiplier", expected.alias("expected"), draw.alias("draw"), *also,
    )
    extra = (F.col("draw") < F.col("expected") - F.floor("expected")).cast("bigint")
    return out.select(
        "id", *DIMENSIONS, "tokens", "multiplier", "expected", (F.floor("expected") + extra).alias("copies"), *also
    )


def oracle_sql(rounds: int = ROUNDS, power: float = POWER, keep: float = KEEP, seed: str = SEED) -> str:
    """The same for DuckDB."""
    topic = """CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'tables'
        WHEN contains(text, 'license') OR contains(text, 'License') THEN 'licensing'
        WHEN contains(text, '!! ') THEN 'shouting'
        WHEN contains(text, '***') OR contains(text, '$$$') OR contains(text, '%%%') THEN 'symbols'
        WHEN length(text) >= 8000 THEN 'long prose' WHEN length(text) >= 1500 THEN 'prose' ELSE 'short prose' END"""
    steps = [
        f"""WITH d AS (SELECT doc_id, source, lang AS language, {topic} AS topic,
            len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens FROM documents)""",
        "c AS (SELECT source, language, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
        "f0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM c)",
    ]
    for name in DIMENSIONS:
        steps.append(
            f"t_{name} AS (SELECT {name}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS target"
            f" FROM c WHERE tokens > 0 GROUP BY {name})"
        )
    last = 0
    for _ in range(rounds):
        for name in DIMENSIONS:
            steps.append(
                f"f{last + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (weight), CASE WHEN s.have > 0 THEN f.weight * (coalesce(t.target, 0) / s.have)"
                f" ELSE 0 END AS weight FROM f{last} f JOIN (SELECT {name}, sum(weight) AS have FROM f{last} GROUP BY {name}) s"
                f" ON f.{name} IS NOT DISTINCT FROM s.{name} LEFT JOIN t_{name} t ON f.{name} IS NOT DISTINCT FROM t.{name})"
            )
            last += 1
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {HASH_SPACE}.0"
    return ",\n".join(steps) + f""",
        m AS (SELECT source, language, topic, CASE WHEN tokens > 0 THEN weight / (tokens / sum(tokens) OVER ()) ELSE 0 END
              AS multiplier FROM f{last})
        SELECT d.doc_id, d.source, d.language, d.topic, d.tokens, round(multiplier, 6) AS multiplier,
               round(multiplier * {keep}, 6) AS expected,
               (floor(multiplier * {keep}) + CASE WHEN {draw} < multiplier * {keep} - floor(multiplier * {keep}) THEN 1 ELSE 0 END)::BIGINT AS copies
        FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.language IS NOT DISTINCT FROM m.language
             AND d.topic = m.topic"""
