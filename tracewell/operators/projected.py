"""A scan's projection laid out for reads by key (inventory rows M10, T2, Q9, D17, J21).

Pages lie in folders by their id, links twice: by their source and by their target. The folder of an id is its remainder
by the number of folders, which follows the number of rows, and rows are sorted inside. A read of some ids lists only
their folders, and the files' statistics leave a few row groups of these, so its cost follows what it asks and not the
size of the scan. The summary is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a folder, about.
FOLDER_ROWS = 500_000
#: Ids that one read by key may ask for.
MOST_IDS = 10_000


def lay_out(rows: DataFrame, path: str, key: str, count: int) -> None:
    """Write ``rows``, about ``count``, in folders by ``key``, sorted inside."""
    folders = max(1, -(-count // FOLDER_ROWS))
    placed = rows.withColumn("folder", F.pmod(F.col(key), F.lit(folders)).cast("int"))
    if count:
        placed.repartition(folders, "folder").sortWithinPartitions("folder", key).write.mode("overwrite").partitionBy("folder").parquet(path)
    else:  # no folder would be written, and a read would find no schema
        placed.coalesce(1).write.mode("overwrite").parquet(path)
    rows.sparkSession.createDataFrame([(folders,)], "folders int").coalesce(1).write.mode("overwrite").parquet(f"{path}-folders")


class ProjectedScan:
    """Projected pages (id, ...), links (source_id, target_id, ...) and summary of one scan under a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, pages: DataFrame, links: DataFrame, summary: DataFrame) -> None:
        known = links.where("target_id is not null")
        lay_out(pages, f"{self.folder}/pages", "id", pages.count())
        lay_out(links, f"{self.folder}/links-out", "source_id", links.count())
        lay_out(known, f"{self.folder}/links-in", "target_id", known.count())
        summary.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/summary")

    def summary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/summary")

    def _keyed(self, kind: str, key: str, ids: Sequence[int]) -> DataFrame:
        """Rows of ``kind`` whose ``key`` is among ``ids``: of their folders alone."""
        if len(ids) > MOST_IDS:
            raise ValueError(f"more than {MOST_IDS} ids: join instead")
        path = f"{self.folder}/{kind}"
        folders = self.spark.read.parquet(f"{path}-folders").first().folders
        rows = self.spark.read.parquet(path)
        return rows.where(F.col("folder").isin(sorted({i % folders for i in ids})) & F.col(key).isin(sorted(set(ids)))).drop("folder")

    def pages(self, ids: Sequence[int]) -> DataFrame:
        return self._keyed("pages", "id", ids)

    def links_from(self, ids: Sequence[int]) -> DataFrame:
        return self._keyed("links-out", "source_id", ids)

    def links_to(self, ids: Sequence[int]) -> DataFrame:
        return self._keyed("links-in", "target_id", ids)

    def around(self, focus: int, hops: int, max_nodes: int = 500, self_links: bool = True, missing_ok: bool = False) -> list[tuple[int, int]]:
        """(id, hop) of the nodes within ``hops`` links of ``focus`` in either direction, nearest first, ties by ascending
        id, ``max_nodes`` at most. Only what is still wanted of a hop leaves the executors. A focus that the scan does not
        have is an error, or, with ``missing_ok``, alone."""
        if self.pages([focus]).isEmpty():
            if missing_ok:
                return [(focus, 0)]
            raise ValueError(f"no page {focus} in this scan")
        seen = {focus: 0}
        frontier = [focus]
        for hop in range(1, hops + 1):
            if not frontier or len(seen) >= max_nodes:
                break
            out, back = self.links_from(frontier).where("target_id is not null"), self.links_to(frontier)
            ends = out.select(F.col("target_id").alias("id")).union(back.select(F.col("source_id").alias("id")))
            if not self_links:
                ends = out.where("source_id != target_id").select(F.col("target_id").alias("id")).union(back.where("source_id != target_id").select(F.col("source_id").alias("id")))
            frontier = [r.id for r in ends.where(~F.col("id").isin(list(seen))).distinct().orderBy("id").limit(max_nodes - len(seen)).collect()]
            seen |= dict.fromkeys(frontier, hop)
        return sorted(seen.items(), key=lambda x: (x[1], x[0]))

    def graph(self, focus: int, hops: int, max_nodes: int = 500, self_links: bool = True, missing_ok: bool = False) -> tuple[DataFrame, DataFrame]:
        """The pages around ``focus``, with their hop, and the links among them."""
        found = self.around(focus, hops, max_nodes, self_links, missing_ok)
        ids = [i for i, _ in found]
        near = F.broadcast(self.spark.createDataFrame(found, "id long, hop int"))
        links = self.links_from(ids).where(F.col("target_id").isin(ids))
        return self.pages(ids).join(near, "id"), links if self_links else links.where("source_id != target_id")

    def detail(self, ids: Sequence[int]) -> DataFrame:
        """The pages of ``ids`` with their links in and out."""
        count = lambda rows, key, name: rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name), F.sum("occurrences").alias(f"{name}_occurrences"))
        out = self.pages(ids).join(count(self.links_from(ids), "source_id", "links_out"), "id", "left").join(count(self.links_to(ids), "target_id", "links_in"), "id", "left")
        return out.fillna(0, subset=["links_out", "links_out_occurrences", "links_in", "links_in_occurrences"])
