"""Deduplicated pools that are kept up to date: a late row may stand anywhere in its pool and undo merges behind it.

The walk that decides owners never looks beyond rows that share a bucket, directly or through others. A kept row
therefore carries the component of its buckets. Rows that come or change are joined with the kept ones by bucket; the
components they touch are decided anew as a whole, all others stay as they are, and only rows of touched components are
written. Components lie inside one (query, site), so the table is cut into parts by these and a batch reads only the parts
that it has rows of. The result is that of the full walk over the pool as it stands, in whatever order rows came."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmerge import schemas
from hitmerge.operators.components import components
from hitmerge.operators.dedup import POS, Q, _buckets, features, find_owners
from hitmerge.operators.hits import pool_order
from hitmerge.operators.numbering import number_rows
from hitmerge.session import cut_lineage

_HIT = (f"query_id string, url string, engine array<string>, positions map<string,bigint>, title string, snippet string, date string, "
        f"signals {schemas.SIGNALS}, first_seen struct<engine:string,ord:bigint>")
KEPT = _HIT + ", grp string, buckets array<bigint>, component bigint, owner_url string, reason string, batch bigint, part int"
HIT_COLUMNS = ["query_id", "url", "engine", "positions", "title", "snippet", "date", "signals", "first_seen"]


class KeptDedup:
    """Deduplicated pools in a folder that all executors share.

    :param folder: of the tables; batches are numbered by the caller, and a repeated batch replaces itself
    :param parts: into which the rows are cut
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64, mode: str = "default"):
        self.spark, self.folder, self.parts, self.mode = spark, folder, parts, mode

    def _path(self) -> str:
        return f"{self.folder}/rows"

    def _stored(self) -> DataFrame | None:
        """All versions of the rows; None before the first batch."""
        try:
            return self.spark.read.schema(KEPT).parquet(self._path())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (Q, "url")]
        return rows.groupBy(Q, "url").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(Q, "url", "r.*")

    def _with_buckets(self, hits: DataFrame) -> DataFrame:
        flat = hits.withColumn("hit_ord", F.xxhash64(Q, "url"))
        f = features(flat, self.mode).withColumn("buckets", _buckets()).select(Q, "url", "grp", "buckets")
        part = F.pmod(F.xxhash64(Q, "grp"), F.lit(self.parts)).cast("int")
        return hits.select(*HIT_COLUMNS).join(f, [Q, "url"]).withColumn("part", part)

    def add(self, changed: DataFrame, batch: int) -> DataFrame:
        """Take in hits that are new or changed and decide the components they touch.

        :param changed: ``HIT_COLUMNS``, one row per (query, URL), as ``exact_merge`` or the stream of merged hits gives them
        :return: the rows written: those of all touched components, with ``owner_url`` and ``reason`` where absorbed
        """
        new = cut_lineage(self._with_buckets(changed))
        stored, region = self._stored(), new.select(*HIT_COLUMNS, "grp", "buckets", "part")
        if stored is not None:
            parts = [r["part"] for r in new.select("part").distinct().collect()]        # at most ``parts``
            kept = cut_lineage(self._latest(stored.where(F.col("part").isin(parts) & (F.col("batch") != batch))))
            asked = new.select(Q, F.explode("buckets").alias("bucket")).distinct()
            touched = kept.select(Q, "component", F.explode("buckets").alias("bucket")).join(asked, [Q, "bucket"], "left_semi").select(Q, "component") \
                .unionByName(kept.join(new.select(Q, "url"), [Q, "url"], "left_semi").select(Q, "component")).distinct()
            others = kept.join(touched, [Q, "component"], "left_semi").join(new.select(Q, "url"), [Q, "url"], "left_anti")
            region = region.unionByName(others.select(*region.columns))
        flat = region.withColumns({"__lead": F.col("first_seen.engine"), "__ord": F.col("first_seen.ord")})
        region = cut_lineage(number_rows(flat, [Q], "__ord", "hit_ord", lead=["__lead"]).drop("__lead", "__ord"))
        owners = find_owners(region.select(Q, "hit_ord", "engine", "positions", "title", "snippet", "url", "date", "signals"), self.mode)
        place = region.select(Q, F.col("hit_ord").alias("owner"), F.col("url").alias("owner_url"))
        decided = owners.join(place, [Q, "owner"]).select(Q, F.col(POS).alias("hit_ord"), "owner_url", "reason")
        node = F.xxhash64(Q, "url")
        linked = components(region.select(node.alias("u"), F.explode("buckets").alias("b"), Q).select("u", F.xxhash64(Q, "b", F.lit("bucket")).alias("v")))
        out = region.withColumn("node", node).join(decided, [Q, "hit_ord"], "left").join(linked, "node", "left") \
            .withColumn("component", F.coalesce("component", "node"))
        out.select(*HIT_COLUMNS, "grp", "buckets", "component", "owner_url", "reason", "part") \
            .write.mode("overwrite").partitionBy("part").parquet(f"{self._path()}/batch={batch}")
        return self.spark.read.schema(KEPT).parquet(self._path()).where(F.col("batch") == batch)

    def pool(self) -> DataFrame:
        """The kept pool with its order; ``owner_url`` and ``reason`` are null on surviving rows."""
        rows = self._latest(self.spark.read.schema(KEPT).parquet(self._path()))
        return pool_order(rows.select(*HIT_COLUMNS, "owner_url", "reason"))

    def owners(self) -> DataFrame:
        """query_id, pos, owner, reason as the full walk over ``pool`` gives them."""
        p = self.pool()
        place = p.select(Q, F.col("url").alias("owner_url"), F.col("hit_ord").alias("owner"))
        return p.where("owner_url is not null").join(place, [Q, "owner_url"]).select(Q, F.col("hit_ord").alias(POS), "owner", "reason")
