"""Quality by hierarchical empirical Bayes.

A document's own evidence is the calibrated log-likelihood ratio of an n-gram
classifier. It is combined with the quality rate of its path, which is shrunk
toward the rate of its host, which is shrunk toward the global rate; the
strength of both shrinkages is estimated from the spread of the rates (method
of moments), so that sparse sites fall back on what is above them. A document
doesn't count in the rates that judge it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmill.llm.linear import Model, sigmoid, train
from rillmill.llm.shared import cut, lean, sheltered

SAMPLE_ROWS = 4000
THRESHOLD = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def site_columns(docs: DataFrame) -> dict[str, Column]:
    """Host and path of a row: the source up to its first slash, and the next segment, or the language where the source has none. What is null or absent is ''."""
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in docs.columns else F.lit("")
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    parts = F.split(source, "/", 3)
    return {"_host": parts[0], "_path": F.when(F.size(parts) > 1, parts[1]).otherwise(lang)}


def evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """docs' columns ``keep``, with _host, _path and _p, the classifier's probability under the base rate; a blank text is 0."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.a, model.b, model.base))
    site = site_columns(docs)
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]), *(c.alias(n) for n, c in site.items()))
    schema = rows.select(*keep, *site).withColumn("_p", F.lit(0.0)).schema

    def run(batches):
        m = Model(*shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            p = np.clip(np.round(sigmoid(m.log_odds(texts)), 6), 1e-6, 1 - 1e-6)
            p[[not t or t.isspace() for t in texts]] = 0.0
            names = [f.name for f in schema][:-1]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(p)], [f.name for f in schema])

    return rows.mapInArrow(lean(run), schema)


def strength(rate: Column, spread: Column) -> Column:
    """Pseudo-count of a beta prior with this mean and variance."""
    return F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), rate * (1 - rate) / F.greatest(spread, F.lit(1e-9)) - 1))


def rates(scored: DataFrame) -> DataFrame:
    """One row for each (host, path): sums and counts of path and host, the global rate and both strengths.

    Groups are aggregated with partial sums, so a hot host costs nothing more;
    only the table of groups is joined.
    """
    path = cut(scored.groupBy("_host", "_path").agg(F.sum("_p").alias("_ps"), F.count("_p").cast("double").alias("_pn")))
    host = path.groupBy("_host").agg(F.sum("_ps").alias("_hs"), F.sum("_pn").alias("_hn"))
    world = host.agg(
        (F.sum("_hs") / F.sum("_hn")).alias("_mu"),
        F.sum("_hn").alias("_n"),
        F.sum(F.col("_hn") ** 2).alias("_n2"),
        F.sum(F.col("_hs") ** 2 / F.col("_hn")).alias("_between"),
        F.count("*").alias("_groups"),
    )
    mu, n = F.col("_mu"), F.col("_n")
    spread = (F.col("_between") - n * mu * mu - (F.col("_groups") - 1) * mu * (1 - mu)) / F.greatest(n - F.col("_n2") / n, F.lit(1.0))
    world = world.select("_mu", strength(mu, spread).alias("_hk"))
    host = host.crossJoin(F.broadcast(world))
    sites = path.join(host, "_host")
    prior = (F.col("_hs") + F.col("_hk") * F.col("_mu")) / (F.col("_hn") + F.col("_hk"))
    diff = F.col("_ps") / F.col("_pn") - prior
    inner = sites.agg(
        F.sum(F.col("_pn") * diff**2).alias("_b"),
        F.sum(prior * (1 - prior)).alias("_v"),
        F.sum("_pn").alias("_n"),
        F.sum(F.col("_pn") ** 2 / F.col("_hn")).alias("_n2"),
        F.avg(prior).alias("_m"),
    )
    spread = (F.col("_b") - F.col("_v")) / F.greatest(F.col("_n") - F.col("_n2"), F.lit(1.0))
    inner = inner.select(strength(F.col("_m"), spread).alias("_pk"))
    return sites.crossJoin(F.broadcast(inner))


def posterior(base: float) -> Column:
    """Probability of quality from _p and the columns of ``rates``, rounded to six places."""
    p = F.col("_p")
    host = (F.col("_hs") - p + F.col("_hk") * F.col("_mu")) / (F.col("_hn") - 1 + F.col("_hk"))
    path = (F.col("_ps") - p + F.col("_pk") * host) / (F.col("_pn") - 1 + F.col("_pk"))
    path = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), path))
    odds = F.log(p / (1 - p)) - F.lit(float(np.log(base / (1 - base)))) + F.log(path / (1 - path))
    return F.when(p <= 0, F.lit(0.0)).otherwise(F.round(1 / (1 + F.exp(-odds)), 6))


def quality_posteriors(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_all: bool = False) -> DataFrame:
    """doc_id, or with keep_all all columns of docs (extra ones by other names, see ``sheltered``), and ``posterior`` for every row of docs.

    Rates count every row; a blank or null text counts as evidence 0 and has
    posterior 0. Whole texts are scored, however long. Null sources and languages are a site of their own, null ids
    are scored like others, repeated rows give repeated rows and equal texts of a site equal posteriors, an empty table
    an empty result. Labels of one class, none, or fewer than ``linear.LEAST_ROWS`` leave the base rate as the
    only evidence. Columns that aren't used are not read, whatever their names.
    Every text is scored once: the scored rows are written to the shared folder and read again with the rates.
    """
    model = train(docs, labels, "quality", sample_rows)
    docs = sheltered(docs)
    keep = docs.columns if keep_all else ["doc_id"]
    scored = cut(evidence(docs, model, keep))
    sites = cut(rates(scored.select("_host", "_path", "_p")))
    joined = scored.join(sites, ["_host", "_path"])
    return joined.select(*keep, posterior(model.base).alias("posterior"))


def quality_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep_all: bool = False, **params) -> DataFrame:
    """The rows with a posterior of at least ``threshold``; see ``quality_posteriors``."""
    return quality_posteriors(docs, labels, keep_all=keep_all, **params).where(F.col("posterior") >= threshold)
