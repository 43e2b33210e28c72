"""A corpus pipeline of five operators: quality rules, exact dedup, near-duplicate join, source mixing, packing.

Each stage takes what its predecessor kept and returns documents (the last: packed pieces). Stages judge their own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import Workspace, restrict


def _plain(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ... in their order, so that no name of a column can clash with the operators' own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def _name(docs: DataFrame, col: str) -> str:
    return f"c{docs.columns.index(col)}"


def _as(plain: DataFrame, docs: DataFrame) -> DataFrame:
    return plain.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _numbered(docs: DataFrame, ws: Workspace) -> DataFrame:
    """A table of docs (columns as in _plain) with a number for each row, written so that every later read has the same."""
    return ws.put(_plain(docs).withColumn("row", F.monotonically_increasing_id()), "rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row is judged by itself: a repeated id or row, a null id or text is one
    more document, on its own host."""
    from rillflow.llm.quality_rules import judge, measure

    ws = Workspace(spark, "pipeline-quality")
    measured = ws.put(measure(_plain(docs), _name(docs, "text")), "measured")
    return _as(judge(measured, _name(docs, "source")).where("kept"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the smallest id, once even where the row itself is repeated. A null text
    is empty; a null id is smaller than any."""
    from rillflow.llm.exact_dedup import exact_dedup

    ws = Workspace(spark, "pipeline-exact")
    rows = _numbered(docs, ws)
    found = exact_dedup(rows, _name(docs, "doc_id"), _name(docs, "text"), row_col="row", ws=Workspace(spark, "pipeline-digests"))
    dropped = ws.put(found.where("not kept").select("row"), "dropped")
    return _as(_without(rows, dropped, "row"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (five-word shingles, similarity of 0.8 or more). Rows of one id are one
    document and go or stay together; those without an id or without words stay."""
    from rillflow.llm.ngram_join import jaccard_components

    ws = Workspace(spark, "pipeline-near")
    inner = Workspace(spark, "pipeline-jaccard")
    found = ws.put(jaccard_components(docs, k=5, num=80, den=100, ws=inner), "found")
    inner.drop("")
    dropped = found.where("component_id < doc_id").select("doc_id").distinct()
    return _without(docs, dropped, "doc_id").select(docs.columns)


#: Factors on each domain's words: low quality and toxic text is thinned, good text stays whole (rates go up to 1).
TARGETS = {"good": 1.0, "low": 0.5, "toxic": 0.1}


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the fitted rates, at most once each. Each row is drawn by itself; one without words has rate 1."""
    from rillflow.llm.source_mixing import mix_sources

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ws = Workspace(spark, "pipeline-mix")
    rows = _numbered(docs, ws)
    drawn = mix_sources(rows, labels, TARGETS, relative=True, max_rate=1.0, id_col=_name(docs, "doc_id"), text_col=_name(docs, "text"), row_col="row")
    dropped = ws.put(drawn.where("copies = 0").select("row"), "dropped")
    return _as(_without(rows, dropped, "row"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, every window at the sources' token proportions. A null text is
    empty, a null source one of its own; repeated rows are packed each."""
    import public_tokenizers

    from rillflow.llm.packing import pack
    from rillflow.llm.tokens import Tokenizer

    return pack(docs, Tokenizer(str(public_tokenizers.path("byte_bpe_50k.json")), added=True), length=1024)


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """docs without the dropped keys; rows that a bounded filter clears do not enter the join's shuffle."""
    maybe = restrict(docs, key, dropped, key)
    clear = restrict(docs, key, dropped, key, inside=False)
    return clear.unionByName(maybe.join(dropped, key, "left_anti"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("source mixing", mix), ("packing", packing)]

#: The last two stages have no SQL form, so the whole has none; tests hold them against brute force. The first three have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = Workspace(spark, "pipeline-run").put(docs, f"stage{i}")
    return docs


def _through(last: int):
    def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for i in range(last + 1):
            docs = STAGES[i][1](spark, docs, sf_dir)
            if i < last:
                docs = Workspace(spark, "pipeline-part").put(docs, f"stage{i}")
        return docs

    return stages


def parts() -> dict:
    """What is left after each of the first three stages, as queries of their own."""
    return {f"pipeline_{name}": _through(i) for i, name in enumerate(("quality", "exact", "near"))}


def parts_sql() -> dict[str, str]:
    from rillflow.llm.queries import STAGE_SQL

    return dict(zip(parts(), STAGE_SQL, strict=True))
