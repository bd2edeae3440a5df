"""Saved meetings as an archive: commits that add, replace and delete folders, and a manifest that is switched last.

A commit writes its rows (folder, file, content, gone) to a place of its own,
by month, and then a new version of the manifest, which lists every place that
counts and at which version it came. A version can be made once: whoever comes
second reads the new manifest and tries the next version, so that two writers
don't lose each other's meetings. What breaks off before the manifest is never seen.

Of a folder its newest commit counts. Deletion has two phases: a commit of
tombstones, which readers pass over from then on; and ``purge``, which writes the
living rows of the months with dead ones anew, switches the manifest, and removes
the places that no longer count. Purging can break off anywhere and be repeated.
A reader that began before a purge may find its places gone: purge when none reads.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = "folder string, file string, content string, gone boolean"


def _month(place: dict) -> str:
    return place["place"].split("month=")[-1]


class Archive:
    """The archive below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.root}/{below}".rstrip("/"))

    # The manifest

    def _versions(self) -> list[int]:
        place = self._path("manifest")
        if not self._fs.exists(place):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self) -> dict:
        """version, places ({place, at}) in the order of their commits, and retired places."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "places": [], "retired": []}
        stream = self._fs.open(self._path(f"manifest/{versions[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, manifest: dict) -> bool:
        """Makes this version; False if someone else has made it."""
        jvm = self.spark._jvm
        draft, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{manifest['version']:012d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        # at once or, where the target is there, not at all
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as failed:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(failed):
                return False
            raise
        return True

    def _write(self, rows: DataFrame) -> list[str]:
        """Writes rows to a place of their own; the months' places below the root."""
        own = f"data/{uuid.uuid4().hex}"
        # ranges, so that a month with most of the meetings is many tasks' work
        dealt = rows.select("folder", "file", "content", "gone").withColumn("month", F.substring("folder", 1, 7)).repartitionByRange("month", "folder")
        dealt.sortWithinPartitions("month", "folder", "file").write.partitionBy("month").parquet(f"{self.root}/{own}")
        found = [status.getPath().getName() for status in self._fs.listStatus(self._path(own))]
        return sorted(f"{own}/{name}" for name in found if name.startswith("month="))

    # Commits

    def commit(self, rows: DataFrame) -> int:
        """Adds (folder, file, content, gone): what the rows have of a folder replaces all that was in it. The version made."""
        written = self._write(rows)
        while written:
            now = self.manifest()
            version = now["version"] + 1
            if self._switch({**now, "version": version, "places": now["places"] + [{"place": p, "at": version} for p in written]}):
                return version
        return self.manifest()["version"]

    def save(self, files: DataFrame) -> int:
        """Saves the folders of (folder, file, content), whose names begin with year and month."""
        return self.commit(files.withColumn("gone", F.lit(False)))

    def delete(self, folders: DataFrame) -> int:
        """First phase of deletion: the folders of (folder) are passed over from now on."""
        none = F.lit(None).cast("string")
        return self.commit(folders.select("folder").distinct().select("folder", none.alias("file"), none.alias("content"), F.lit(True).alias("gone")))

    # Readers

    def _rows(self, places: list[dict]) -> DataFrame:
        """(folder, file, content, gone, at) of some places."""
        paths = [f"{self.root}/{p['place']}" for p in places]
        found = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]+/month=[^/]*)/[^/]*$", 1)
        rows = self.spark.read.schema(ROWS).parquet(*paths).select("*", found.alias("place"))
        at = self.spark.createDataFrame([(p["place"], p["at"]) for p in places], "place string, at long")
        # a row for each commit and month: the manifest that the driver holds
        return rows.join(F.broadcast(at), "place").select("folder", "file", "content", "gone", "at")

    def _living(self, places: list[dict]) -> DataFrame:
        rows = self._rows(places)
        if len({p["at"] for p in places}) > 1:
            rows = rows.withColumn("newest", F.max("at").over(W.partitionBy("folder"))).filter("at = newest").drop("newest")
        return rows.filter(~F.col("gone"))

    def files(self) -> DataFrame:
        """(folder, file, content) as they are now."""
        places = self.manifest()["places"]
        if not places:
            return self.spark.createDataFrame([], "folder string, file string, content string")
        return self._living(places).select("folder", "file", "content")

    # Second phase of deletion

    def purge(self) -> int:
        """Drops what newer commits have replaced or deleted; how many places were written anew."""
        anew = 0
        while True:
            places = self.manifest()["places"]
            months = self._untidy(places)
            old = [p for p in places if _month(p) in months]
            if not old:
                break
            written = self._write(self._living(old))
            if self._replace(old, written):
                anew += len(written)
        self._remove_retired()
        return anew

    def _replace(self, old: list[dict], written: list[str]) -> bool:
        """Puts what was written in place of the old places; False if someone else has purged them."""
        gone, at = {p["place"] for p in old}, max(p["at"] for p in old)
        while True:
            now = self.manifest()
            if not gone <= {p["place"] for p in now["places"]}:
                return False
            kept = [p for p in now["places"] if p["place"] not in gone] + [{"place": w, "at": at} for w in written]
            if self._switch({"version": now["version"] + 1, "places": kept, "retired": now["retired"] + sorted(gone)}):
                return True

    @staticmethod
    def _untidy(places: list[dict]) -> set[str]:
        """Months that more than one commit has touched."""
        return {m for m, n in Counter(map(_month, places)).items() if n > 1}

    def _remove_retired(self) -> None:
        while retired := self.manifest()["retired"]:
            for place in retired:
                self._fs.delete(self._path(place), True)  # gone already is well
            latest = self.manifest()
            self._switch({**latest, "version": latest["version"] + 1, "retired": [p for p in latest["retired"] if p not in retired]})
