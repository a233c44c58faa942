"""From packed context to an answer: the model is a callable, all else is relational."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import CONTEXT_CLOSE, CONTEXT_OPEN

# Fixed value: the answer where nothing was found.
NO_EVIDENCE = "I could not find relevant repository evidence for this question."


@dataclass(frozen=True)
class Providers:
    """What runs outside Spark: embed(texts) -> vectors, answer(question, context) -> (text, source ids)."""

    embed: Callable[[list[str]], list[list[float]]] | None = None
    answer: Callable[[str, str], tuple[str, list[str]]] | None = None


def contexts(questions: DataFrame, packed: DataFrame, block: str) -> DataFrame:
    """query_id, query, context (null where nothing is packed): blocks in order, a blank line apart, in their frame."""
    joined = packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_no", block))), lambda b: b[block]), "\n\n").alias("context")).withColumn("context", F.concat(F.lit(CONTEXT_OPEN), "context", F.lit("\n" + CONTEXT_CLOSE)))
    return questions.join(joined, "query_id", "left")


def citations(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """query_id, source_no, path, start_line, end_line of what an answer cites (source_ids: S1, S2..), each once; unknown ids have a null path."""
    cited = answers.select("query_id", F.posexplode("source_ids").alias("at", "source_id")).withColumn("source_no", F.regexp_extract("source_id", r"^S(\d+)$", 1).cast("long"))
    first = cited.groupBy("query_id", "source_id", "source_no").agg(F.min("at").alias("at"))
    return first.join(packed.select("query_id", "source_no", "path", "start_line", "end_line"), ["query_id", "source_no"], "left").orderBy("query_id", "at").drop("at")


def answered(contexts_of: DataFrame, providers: Providers) -> DataFrame:
    """query_id, answer, source_ids. Questions go through the model in Arrow batches; without context none is asked."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = [providers.answer(q, c) if c is not None else (NO_EVIDENCE, []) for q, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))], names=["query_id", "answer", "source_ids"])

    return contexts_of.select("query_id", "query", "context").mapInArrow(run, "query_id long, answer string, source_ids array<string>")


def embedded(chunks: DataFrame, text: str, providers: Providers, model: str, batch: int = 64) -> DataFrame:
    """chunks with embedding and embedding_model, batch texts at a time; a provider that returns another number of vectors is an error."""
    import pyarrow as pa

    at, names = chunks.columns.index(text), [*chunks.columns, "embedding", "embedding_model"]

    def run(batches):
        for rows in batches:
            vectors: list[list[float]] = []
            texts = rows.column(at).to_pylist()
            for a in range(0, len(texts), batch):
                made = providers.embed(texts[a : a + batch])
                if len(made) != len(texts[a : a + batch]):
                    raise ValueError("the embedder returned another number of vectors")
                vectors += made
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array([model] * len(texts), pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInArrow(run, f"{fields}, embedding array<double>, embedding_model string")
