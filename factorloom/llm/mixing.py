"""Mix sources to target weights by capped water-filling.

Sources in code point order, null last, take the weights in turn. They share ``share`` times
all words by weight, but a source gives at most ``max_epochs`` times its own words: sources
above are clamped and their excess is shared anew by weight until none is above. Only the level
(words per unit of weight) is on the driver; each round is one aggregation of the sources.

A target is met by whole repetitions of the source and a seeded fraction: in the order of a hash
of the document id, documents are taken once more until the remaining words are used; the last
one is taken in part. The place of that document is found digit by digit of the hash, so no
source is ever sorted in one task.

A null text has size 0, a null source is a source, a null id is an id. Rows that share an id get
their share of its words in proportion to their size, so equal rows get equal results. An empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.ranking import with_position
from factorloom.functions.session import materialize
from factorloom.llm.common import WORD, Shield, table, tune

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
DIGITS = 3  # hexadecimal digits of the hash for each narrowing: at most 4096 sums a source
ROUNDS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: str, seed: str) -> Column:
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Add ``_size`` (words of the whole text) and ``_key`` (seeded order of the documents)."""
    return docs.withColumns({"_size": words(F.col("text").cast("string")), "_key": _key("doc_id", seed)})


def water_level(sources: DataFrame, share: float, max_epochs: int) -> tuple[float, float]:
    """(words, weights) of the sources that are not clamped; their ratio is the level.

    The level only rises, so a clamped source stays clamped and the rounds end.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight, level = 0.0, 0.0, -1.0
    while True:
        clamped = cap < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(clamped, cap)).alias("used"), F.sum(F.when(~clamped, F.col("weight"))).alias("weight")
        ).first()
        left, weight = share * total - (row["used"] or 0), float(row["weight"] or 0)
        now = left / weight if weight else level
        if now <= level or not weight:
            return left, weight
        level = now


def plan_mix(
    rows: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> tuple[DataFrame, DataFrame]:
    """Targets of the sources, and the documents at the edge of each source's fraction.

    ``rows`` has source, _size and _key. The first table holds, for each source, its size,
    target, whole repetitions, remaining words and the hash prefix where they run out.
    """
    sizes = materialize(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), "source-sizes")
    placed = with_position(sizes, "_place", [F.col("source").asc_nulls_last()])
    turn = F.array(*[F.lit(w) for w in weights])[((F.col("_place") - 1) % len(weights)).cast("int")]
    sources = materialize(placed.select("source", "source_size", turn.alias("weight")), "sources")
    left, weight = water_level(sources, share, max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    target = F.least(cap, F.col("weight") * F.lit(left) / F.lit(weight or 1.0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    edges = sources.select("source", "source_size", target.alias("target")).withColumn(
        "epochs", epochs.cast("long")
    )
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")
    edges = edges.withColumns({"rest": rest, "prefix": F.lit(""), "prior": F.lit(0).cast("long")})
    for step in range(1, ROUNDS + 1):
        edges = materialize(_narrow(rows, edges, step * DIGITS), "mix-edges")
    at_edge = _inside(rows, edges, ROUNDS * DIGITS).groupBy("source", "_key", "prior").agg(
        F.sum("_size").alias("key_size")
    )
    before = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("prior") + F.coalesce(F.sum("key_size").over(before), F.lit(0))
    return edges, materialize(at_edge.select("source", "_key", "key_size", prior.alias("key_prior")), "mix-edge-keys")


def _inside(rows: DataFrame, edges: DataFrame, digits: int) -> DataFrame:
    """The rows under the edge prefix of their source."""
    own = edges.select(F.col("source").alias("_source"), "rest", "prefix", "prior")
    return rows.select("source", "_size", "_key").join(
        own,
        F.col("source").eqNullSafe(F.col("_source")) & (F.substring("_key", 1, digits) == F.col("prefix")),
    )


def _narrow(rows: DataFrame, edges: DataFrame, digits: int) -> DataFrame:
    """Move each source's edge on to the prefix of ``digits`` digits where its words run out."""
    under = _inside(rows, edges, digits - DIGITS) if digits > DIGITS else _inside_all(rows, edges)
    sums = under.groupBy("source", "rest", "prior", F.substring("_key", 1, digits).alias("digits")).agg(
        F.sum("_size").alias("words")
    )
    running = Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
    reached = sums.withColumn("through", F.col("prior") + F.sum("words").over(running))
    found = (
        reached.filter(F.col("through") >= F.col("rest"))
        .groupBy(F.col("source").alias("_source"))
        .agg(F.min(F.struct("digits", (F.col("through") - F.col("words")).alias("start"))).alias("_edge"))
    )
    joined = edges.drop("prefix", "prior").join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(
        *[c for c in edges.columns if c not in ("prefix", "prior")],
        F.col("_edge.digits").alias("prefix"),
        F.coalesce("_edge.start", F.lit(0)).cast("long").alias("prior"),
    )


def _inside_all(rows: DataFrame, edges: DataFrame) -> DataFrame:
    own = edges.select(F.col("source").alias("_source"), "rest", "prior")
    return rows.select("source", "_size", "_key").join(own, F.col("source").eqNullSafe(F.col("_source")))


def apply_mix(rows: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Add source_size, target and taken (words) to rows with source, _size and _key."""
    own = edges.withColumnsRenamed({c: f"_edge_{c}" for c in edges.columns})
    at = keys.withColumnsRenamed({c: f"_at_{c}" for c in keys.columns})
    joined = rows.join(own, rows["source"].eqNullSafe(own["_edge_source"])).join(
        at, rows["source"].eqNullSafe(at["_at_source"]) & (rows["_key"] == at["_at__key"]), "left"
    )
    head, size = F.substring("_key", 1, ROUNDS * DIGITS), F.col("_size")
    left = F.col("_edge_rest") - F.col("_at_key_prior")
    part = F.when(left <= 0, F.lit(0)).when(left >= F.col("_at_key_size"), size).otherwise(
        F.expr("(_edge_rest - _at_key_prior) * _size div _at_key_size")
    )
    more = (
        F.when(F.col("_edge_rest") <= 0, F.lit(0))
        .when(F.col("_edge_prefix").isNull() | (head < F.col("_edge_prefix")), size)
        .when(head > F.col("_edge_prefix"), F.lit(0))
        .otherwise(part)
    )
    return joined.select(
        *[rows[c] for c in rows.columns],
        F.col("_edge_source_size").alias("_source_size"),
        F.col("_edge_target").alias("_target"),
        (F.col("_edge_epochs") * size + more).cast("long").alias("_taken"),
    )


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as whole documents: each row as often as it is taken, in its own columns.

    A document that is taken in part counts as taken from half of its words on. Documents
    without words are kept once: they cost nothing.
    """
    tune(docs.sparkSession)
    shield = Shield(docs, "doc_id", "source", "text")
    rows = materialize(sized(shield.docs, seed).select("doc_id", "source", "_size", "_key"), "mix-rows")
    taken = apply_mix(sized(shield.docs, seed), *plan_mix(rows))
    copies = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(1)
    repeated = taken.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return shield.restore(
        repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    )


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = materialize(sized(docs).select("doc_id", "source", "_size", "_key"), "mix-rows")
    return apply_mix(rows, *plan_mix(rows)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


OP5_SQL = r"""
WITH sizes AS (
    SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM sizes GROUP BY source
), ranked AS (
    SELECT *, 2 * source_size AS cap,
        row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM sources
), levels AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
        sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
    FROM ranked
), clamped AS (
    SELECT *, cap < weight * ((total - used) / free) AS above FROM levels
), level AS (
    SELECT any_value(total) - coalesce(sum(CASE WHEN above THEN cap END), 0) AS words,
        sum(CASE WHEN NOT above THEN weight END)::DOUBLE AS weights
    FROM clamped
), targets AS (
    SELECT source, source_size, least(cap::DOUBLE, weight * words / coalesce(weights, 1.0)) AS target
    FROM clamped, level
), epochs AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets
), rests AS (
    SELECT *, floor(target - epochs * source_size + 0.5)::BIGINT AS rest FROM epochs
), keys AS (
    SELECT source, key, sum(size)::BIGINT AS key_size,
        coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY key
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
    FROM sizes GROUP BY source, key
)
SELECT s.doc_id, s.size, r.source_size, r.target,
    (r.epochs * s.size + CASE WHEN r.rest - k.prior <= 0 THEN 0 WHEN r.rest - k.prior >= k.key_size THEN s.size
        ELSE (r.rest - k.prior) * s.size // k.key_size END)::BIGINT AS taken
FROM sizes s
JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
JOIN keys k ON s.source IS NOT DISTINCT FROM k.source AND s.key = k.key
"""
