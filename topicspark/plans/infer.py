"""Topics of documents under a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from topicspark.functions.vectors import literal_vector, vec_normalise
from topicspark.operators.corpus import for_every_document
from topicspark.plans import online_vb, scvb0
from topicspark.plans.minibatch import parameter_totals
from topicspark.session import Scratch


def doc_topics(bow: DataFrame, model: DataFrame, cfg, n_words: int, normalise: bool = False,
               scratch: Scratch | None = None, documents: DataFrame | None = None) -> DataFrame:
    """`(doc_id, theta)` for an `OnlineVB` model (gamma) or an `SCVB0` model (N_theta), the model held fixed.

    With `documents(doc_id)` those without words appear too: gamma is alpha, N_theta has no counts.
    """
    scratch = scratch or Scratch(bow.sparkSession, "infer")
    if isinstance(cfg, scvb0.SCVB0):
        docs = scvb0.document_topics(bow, model, n_words, cfg, scratch)
    else:
        totals = parameter_totals(model, cfg.n_topics)
        docs = online_vb.document_posteriors(bow, model, totals, cfg, scratch, "estep")
    vec = F.col("vec")
    if documents is not None:
        none = [0.0] * cfg.n_topics if isinstance(cfg, scvb0.SCVB0) else cfg.alpha_vec
        docs = for_every_document(docs.select("doc_id", "vec"), documents, vec=literal_vector(none))
    return docs.select("doc_id", (vec_normalise(vec) if normalise else vec).alias("theta"))


def counted_doc_topics(doc_topic: DataFrame, n_topics: int, value: str = "n", documents: DataFrame | None = None) -> DataFrame:
    """`(doc_id, theta)` from sparse `(doc_id, topic, n)` counts, zeros filled in, also for listed documents without counts."""
    sums = [F.sum(F.when(F.col("topic") == k, F.col(value)).otherwise(F.lit(0))).cast("double")
            for k in range(n_topics)]
    return for_every_document(doc_topic.groupBy("doc_id").agg(F.array(*sums).alias("theta")), documents,
                              theta=literal_vector([0.0] * n_topics))
