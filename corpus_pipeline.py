"""A training-corpus pipeline over ``documents``, stage by stage.

1. quality rules: documents that fail, or whose host fails, go;
2. language identification: documents unlike every learned language go;
3. near-duplicates: one document of each class stays, the one with the least id;
4. mixing: rows are put in the order that target weights of their sources ask for;
5. byte-level BPE: every document is encoded and decoded.

Each stage works on all that the one before kept, returns the columns of
``documents``, and is written and read again before the next.  The last one
returns digests, and beside them ``mix_slot`` and ``mix_pos``, a document's
place in the mix: the order of files read back is not promised by Spark, so the
place is derived again from ids, sources and texts, of which the schedule is a
function.  Columns that the stages do not know, whatever they are called, are
carried along.  Null texts fail the quality rules; null ids and sources are
kept by the rules of each operator; empty tables stay empty.

Tables that a stage leaves in the shared folder are deleted when the next stage
begins, as its output has been written by then; stages of several pipelines
must not be interleaved in one process.  Executors collect their garbage at
that time too, so that a stage's memory does not come on top of what the ones
before it have left: a JVM keeps a heap that has grown, and workers come beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.durable import delete, durable, recorded, tidy_executors
from kinfold.llm import bytebpe, langid, mixing, omh, quality
from kinfold.llm.queries import _pattern, _vocabulary
from kinfold.session import ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def staged(stage: Stage) -> Stage:
    """``stage``, which first deletes what the stage before it has left and ``docs`` does not read."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {f.rpartition("/")[0].rpartition("/")[2] for f in docs.inputFiles()}
        delete(spark, [p for p in _left if p.rpartition("/")[2] not in read])
        ship(spark)
        tidy_executors(spark)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _left[:] = made
        return out

    return run_stage


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base rules and comes from a host that is not rejected."""
    return quality.filter_kept(docs)


@staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is about as like some learned language as labelled texts are.

    Profiles and the least score come from all labelled rows of ``docs``; without any, all rows with a letter stay.
    """
    profiles = langid.fit(docs, max_train_docs=None)
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.filter_known(docs, profiles, langid.least_score(docs, profiles))


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class."""
    return omh.keep_one(docs)


@staged
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the Pfair schedule for tempered source weights."""
    return mixing.in_order(mixing.mix(docs, durable(mixing.tempered_weights(docs), "mix-weights"), text_col="text"))


@staged
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token count, the digests of its ids and of the decoded bytes, and its place in the mix."""
    keep = F.col("source"), F.md5(F.col("text").cast("binary")).alias("mark")
    coded = durable(bytebpe.digests(docs, _vocabulary("byte_bpe_50k.tiktoken"), _pattern(), keep=keep), "bpe-digests")
    mixed = mixing.mix(coded, durable(mixing.tempered_weights(coded), "mix-weights"), mark_col="mark")
    return mixed.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("__kf_slot").alias("mix_slot"), F.col("__kf_pos").alias("mix_pos"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Tokenisation and alignment have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, before)
        before = [docs._kinfold_path]
    return STAGES[-1][1](spark, docs, sf_dir)
