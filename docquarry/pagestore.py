"""Pages of texts in a folder, upserted by variant: appended generations, merged on reading, compacted by bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.staging import delete, drop, keep, passing_shuffles

VARIANT = ["file_hash", "extracted_by"]


@dataclass(frozen=True)
class PageStore:
    """A table of pages (file_hash, extracted_by, page_id, text, text_bytes).

    `pages/gen=/bucket=` holds what a `put` or `compact` wrote, `heads/gen=` which variants (a file
    as one extractor read it) it wrote and is written last: a generation without it doesn't count.
    A page is read if its generation is the newest of its variant, so a variant's new pages replace
    all that were there: pages above the new last one go too.
    """

    spark: SparkSession
    path: str
    buckets: int = 32

    def _parts(self, table: str, done: bool) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        mark = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{n}/_SUCCESS"))
        return sorted(n for n in names if n.startswith("gen=") and (not done or mark(n)))

    def heads(self) -> DataFrame | None:
        """(variant, gen, bucket, digest, last_page): the newest of each variant; None of an empty store."""
        parts = self._parts("heads", True)
        if not parts:
            return None
        every = self.spark.read.option("basePath", f"{self.path}/heads").parquet(*[f"{self.path}/heads/{p}" for p in parts])
        newest = F.max_by(F.struct("gen", "bucket", "digest", "last_page"), "gen").alias("v")
        return every.groupBy(*VARIANT).agg(newest).select(*VARIANT, "v.*")

    def pages(self) -> DataFrame:
        """The rows that count."""
        return self._live().drop("gen", "bucket")

    def _live(self) -> DataFrame:
        heads = self.heads()
        if heads is None:
            return self.spark.createDataFrame([], "file_hash string, extracted_by string, page_id int, text string, text_bytes long, gen int, bucket int")
        parts = [p for p in self._parts("heads", True) if p in self._parts("pages", False)]
        every = self.spark.read.option("basePath", f"{self.path}/pages").parquet(*[f"{self.path}/pages/{p}" for p in parts])
        # What the newest generation of a bucket wrote counts whole: no text of it is joined, nor shuffled.
        whole = F.lit(False)
        for gen, buckets in self._newest().items():
            whole = whole | ((F.col("gen") == gen) & F.col("bucket").isin(buckets))
        return every.where(whole).unionByName(self._joined(every.where(~whole), heads))

    def _newest(self) -> dict[int, list[int]]:
        """Buckets by the newest generation that has heads in them."""
        parts = self._parts("heads", True)
        every = self.spark.read.option("basePath", f"{self.path}/heads").parquet(*[f"{self.path}/heads/{p}" for p in parts])
        out: dict[int, list[int]] = {}
        for r in every.groupBy("bucket").agg(F.max("gen").alias("gen")).collect():
            out.setdefault(r["gen"], []).append(r["bucket"])
        return out

    @staticmethod
    def _joined(every: DataFrame, heads: DataFrame) -> DataFrame:
        return every.join(heads.select(*VARIANT, "gen", "bucket"), [*VARIANT, "gen", "bucket"], "left_semi")

    def _write(self, gen: int, pages: DataFrame, heads: DataFrame) -> None:
        """Each task writes a file a bucket of what it has, so that texts needn't be shuffled for it."""
        with passing_shuffles(self.spark):
            rows = pages.sortWithinPartitions("bucket", *VARIANT, "page_id")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/pages/gen={gen}")
            heads.write.mode("overwrite").parquet(f"{self.path}/heads/gen={gen}")

    def _next(self) -> int:
        return 1 + max([int(p[4:]) for t in ("pages", "heads") for p in self._parts(t, False)], default=-1)

    def put(self, pages: DataFrame) -> int:
        """Upsert whole variants (file_hash, extracted_by, page_id, text) and give how many changed.

        page_id counts from 1. Texts are stripped; pages with under two characters left aren't
        stored, but count towards the last page. Of rows that share a variant and page the greatest
        text is taken. Variants that are stored just so aren't written again.
        """
        bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
        given = pages.select(*VARIANT, F.col("page_id").cast("int").alias("page_id"), bare.alias("text"), self._bucket().alias("bucket"), self._part().alias("part"))
        # First hashes alone, to see what has changed; texts of unchanged variants aren't shuffled.
        doubled = self._doubled(given)
        hashed = given.groupBy("bucket", *VARIANT, "page_id").agg(F.max("text").alias("text")) if doubled else given
        heads = hashed.groupBy("bucket", *VARIANT).agg(F.hex(F.bit_xor(F.xxhash64("page_id", "text"))).alias("digest"), F.max("page_id").alias("last_page"), F.min(F.coalesce("page_id", F.lit(0))).alias("least"))
        every = keep(heads, "heads-put")
        if every.where("least < 1").limit(1).count():
            drop(every)
            raise ValueError("page_id counts from 1")
        known, new = self.heads(), every.select(*VARIANT, "bucket", "digest", "last_page")
        if known is not None:
            new = new.join(known.select(*VARIANT, "digest", "last_page"), [*VARIANT, "digest", "last_page"], "left_anti")
        new = keep(new, "heads-put")
        changed = new.count()
        if changed:
            chosen = given if changed == every.count() else given.join(new.select(*VARIANT), VARIANT, "left_semi")
            stored = chosen.where(F.length("text") >= 2)
            if doubled:
                stored = stored.repartition("bucket", "part").groupBy("bucket", "part", *VARIANT, "page_id").agg(F.max("text").alias("text"))
            self._write(self._next(), stored.select(*VARIANT, "page_id", "text", F.octet_length("text").cast("long").alias("text_bytes"), "bucket"), new)
        drop(every, new)
        return changed

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*VARIANT), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _part() -> Column:
        """Of a bucket's variants, those that one task writes."""
        return F.pmod(F.hash(*VARIANT), F.lit(4))

    @staticmethod
    def _doubled(given: DataFrame) -> bool:
        """Whether any page is given twice."""
        return bool(given.groupBy(*VARIANT, "page_id").count().where("count > 1").limit(1).count())

    def compact(self) -> list[int]:
        """Rewrite the buckets whose rows lie in several generations as one, delete what they had, and
        give them. Other buckets keep their files."""
        heads = self.heads()
        if heads is None:
            return []
        folders = [(p, b) for p in self._parts("pages", False) for b in self._buckets(p)]
        several = sorted({b for _, b in folders if sum(x == b for _, x in folders) > 1})
        if several:
            live = self._live().where(F.col("bucket").isin(several))
            chosen = keep(heads.where(F.col("bucket").isin(several)).select(*VARIANT, "bucket", "digest", "last_page"), "heads-compact")
            self._write(self._next(), live.select(*VARIANT, "page_id", "text", "text_bytes", "bucket").repartition("bucket", self._part()), chosen)
            drop(chosen)
            for p, b in folders:
                if b in several:
                    delete(self.spark, f"{self.path}/pages/{p}/bucket={b}")
        return several

    def _buckets(self, part: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pages/{part}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [int(n[7:]) for n in (s.getPath().getName() for s in files.listStatus(folder)) if n.startswith("bucket=")]
