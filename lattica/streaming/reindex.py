"""An extension: changed files arrive as a stream; each batch that changes something publishes a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..checkpoints import cut
from ..engine import Engine, build_graph
from ..schema import FILES, NotFound


def apply_changes(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Files with (path, content, version) changes applied: the latest version wins, a null content deletes."""
    from ..functions.text import extension, file_kind, language

    w = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("content"))
    latest = changes.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
    kept = files.join(latest.select("path"), "path", "left_anti").select("path", "ext", "language", "kind", "size", "content")
    p = F.col("path")
    new = latest.where("content is not null").select("path", extension(p).alias("ext"), language(p).alias("language"), file_kind(p).alias("kind"), F.octet_length("content").cast("long").alias("size"), "content")
    return kept.unionByName(new)


def reindex(engine: Engine, repo: str, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """Starts a query that publishes the graph anew after each batch of changes (available now)."""

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        try:
            files = engine.store.read(repo, "files")
        except NotFound:
            files = engine.spark.createDataFrame([], FILES)
        files = cut(apply_changes(files, df))
        nodes, edges = build_graph(files)
        engine.publish(repo, nodes, edges, files, replace=True)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
